import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from paperweir.operators import checks, citations, export, fonts, ingest, library, vault
from paperweir.schemas import ARTICLE, EXPORT, SOURCE
from paperweir.sources import readers, writers

H = "sha256:" + "a" * 64
NOW = "2026-01-01T00:00:00.000Z"


def source(i="src_" + "0" * 16, **k):
    base = {"schemaVersion": 1, "id": i, "kind": "url", "title": "A & B", "authors": ["Ada", "Bo"], "publishedAt": "2024", "capturedAt": NOW, "origin": {"locator": "https://e.test/1", "canonicalUrl": "https://e.test/1"},
            "content": {"path": f"sources/{i}/content.md", "mediaType": "text/markdown", "contentHash": H, "textHash": H, "byteLength": 3}}
    return base | k


def article(i="art_" + "0" * 16, mode="digest", **k):
    sid = "src_" + "0" * 16
    base = {"schemaVersion": 1, "id": i, "mode": mode, "title": 'Say "hi"', "slug": "say-hi", "sourceIds": [sid], "body": {"path": f"articles/{mode}/{i}/content.md", "mediaType": "text/markdown", "contentHash": H, "textHash": H, "byteLength": 3},
            "citations": [{"id": "cite_a", "sourceId": sid, "locator": {"heading": "Part *1*"}, "quote": "q  <x>"}], "createdAt": NOW, "generatedBy": {"provider": "p", "model": "m", "generatedAt": NOW}}
    return base | k


def frames(spark, articles, sources):
    return spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(sources, SOURCE)


def test_rules(spark):
    a, s = frames(spark, [article(), article(i="x", slug="A", sourceIds=[], citations=[]), article(i="art_" + "1" * 16, mode="archive")], [source(), source(i="src_" + "1" * 16, origin={"locator": "x", "canonicalUrl": None})])
    got = {r.id: set(r.violations) for r in checks.check(a, checks.article_rules()).collect()}
    assert got["art_" + "0" * 16] == set()
    assert {"id", "slug", "sources", "derived"} <= got["x"]
    assert got["art_" + "1" * 16] == {"archive"}
    assert {r.id: r.violations for r in checks.check(s, checks.source_rules()).collect()} == {"src_" + "0" * 16: [], "src_" + "1" * 16: ["canonicalUrl"]}
    ok, bad = checks.accept(a, checks.article_rules())
    assert (ok.count(), bad.count()) == (1, 2)


def test_footnotes_and_lists(spark):
    a, s = frames(spark, [article()], [source()])
    assert citations.footnotes(a, s).first().definitions == "[^cite_a]: [A & B](https://e.test/1), Part \\*1\\* — “q <x>”"
    html = citations.citation_section(a, s).first().section
    assert html == '<section class="article-citations"><h2>Sources</h2><ol><li id="cite_a"><span>[1] <a href="https://e.test/1">A &amp; B</a>, Part *1*</span><blockquote>q  &lt;x&gt;</blockquote></li></ol></section>'
    body = spark.createDataFrame([("see [^cite_a] and [^cite_b]",)], "b string")
    out = body.select(citations.replace_markers(F.col("b"), F.array(F.struct(F.lit("cite_a").alias("id"))))).first()[0]
    assert out == 'see <sup class="article-citation"><a href="#cite_a">[1]</a></sup> and [^cite_b]'


def test_marker_audit(spark):
    bodies = spark.createDataFrame([("a", "x [^cite_1] [^cite_2] [^cite_2]"), ("b", "[^cite_9]: no"), ("c", None), ("d", "")], "article_id string, body string")
    listed = spark.createDataFrame([("a", "cite_1"), ("a", "cite_3"), ("a", "cite_3")], "article_id string, id string")
    got = {(r.article_id, r.cite_id, r.problem) for r in citations.marker_audit(bodies, listed).collect()}
    assert got == {("a", "cite_2", "unknown citation"), ("a", "cite_3", "not in the body"), ("b", None, "defines footnotes")}


def test_orphans(spark):
    c = [{"id": "cite_a", "sourceId": "src_x"}, {"id": "cite_a", "sourceId": "src_" + "0" * 16}]
    a, s = frames(spark, [article(citations=c)], [source()])
    got = {(r.id, r.problem) for r in citations.orphan_citations(a, s).collect()}
    assert got == {("cite_a", "source outside the article"), ("cite_a", "unknown source"), ("cite_a", "duplicate id")}
    assert citations.missing_sources(spark.createDataFrame([article(sourceIds=["nope"])], ARTICLE), s).first().source_id == "nope"


def test_slugs(spark):
    rows = [("1", "x", "1"), ("2", "x-2", "2"), ("3", "x", "3"), ("4", "x", "4"), ("5", "y", "5"), ("6", "y", "6"), ("7", "an-example", "7"), ("8", "an-example", "8"), ("9", "an-example", "9")]
    got = {r.id: r.slug for r in library.choose_slugs(spark.createDataFrame(rows, "id string, base string, createdAt string")).collect()}
    assert got == {"1": "x", "2": "x-2", "3": "x-3", "4": "x-4", "5": "y", "6": "y-2", "7": "an-example", "8": "an-example-2", "9": "an-example-3"}


def test_fidelity(spark):
    arch = {"sourceId": "src_" + "0" * 16, "sourceTextHash": H}
    good = article(mode="archive", archiveVerification=arch, generatedBy=None, citations=[])
    bad = good | {"id": "art_" + "2" * 16, "body": good["body"] | {"textHash": "sha256:" + "b" * 64}}
    lost = good | {"id": "art_" + "3" * 16, "sourceIds": ["gone"]}
    a, s = frames(spark, [good, bad, lost], [source(), source()])
    assert {r.article_id[-1]: r.reason for r in library.archive_fidelity(a, s).collect()} == {"0": None, "2": "text hash mismatch", "3": "unknown source"}


def test_archives_of_one_slug_are_verified_each(spark, tmp_path):
    from hashlib import sha256

    from paperweir.plans import library as plans

    page = {"src_a": "z one", "src_b": "another"}
    rows = []
    for k, sid in (("1", "src_a"), ("2", "src_b"), ("3", "src_gone"), ("4", "src_a")):
        text = "something else" if k == "4" else page.get(sid, "")
        rows.append(article(i="art_" + k, mode="archive", slug="same", sourceIds=[sid]) | {"body": article()["body"] | {"textHash": "sha256:" + sha256(text.encode()).hexdigest()}})
    frames(spark, rows + rows[:1], [source()])[0].write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame(list(page.items()), "sourceId string, sourceText string").write.parquet(f"{tmp_path}/web_articles.parquet")
    got = sorted((r.article_id, r.slug, r.status, r.reason, r.characters) for r in plans.fidelity_articles(spark, str(tmp_path)).collect())
    assert got == [("art_1", "same", "pass", None, 5), ("art_2", "same", "pass", None, 7), ("art_3", "same", "fail", "missing page", None), ("art_4", "same", "fail", "text hash mismatch", None)]


def test_stored_text(spark):
    from hashlib import sha256

    h = lambda t: "sha256:" + sha256(t.encode()).hexdigest()
    rows = [("ok", "# É", (h("# É"), h("É"), 4)), ("c", "# É!", (h("# É"), h("É"), 4)), ("t", "# É", (h("# É"), "x", 4)), ("b", "# É", (h("# É"), h("É"), 5))]
    df = spark.createDataFrame(rows, "id string, content string, stored struct<contentHash:string,textHash:string,byteLength:bigint>")
    assert {r.id: r.reason for r in library.stored_text_integrity(df).collect()} == {"ok": None, "c": "content hash mismatch", "t": "text hash mismatch", "b": "byte length mismatch"}


def test_list_order(spark):
    rows = [article(i=f"art_{k}", mode=m, createdAt=t) for k, m, t in (("a", "synthesis", "2"), ("b", "archive", "2"), ("c", "digest", "3"), ("d", "digest", None))]
    a, _ = frames(spark, rows + rows[:1], [source()])
    assert [r.id for r in library.list_articles(a, 9).collect()] == ["art_c", "art_b", "art_a", "art_d"]
    assert library.list_articles(a, 0).count() == 1
    assert library.list_line(a).first().line.split("  ")[0].startswith("art_")


def test_ingest(spark):
    rows = [("text", "Hi *you*\r\n", None), ("markdown", "# T\n\nRead [x](https://e.test).", "m"), ("markdown", "<script>", "m"), ("feed", "x", "f"), ("text", " \n", None), ("url", "<article><p>Body text here.</p></article>", "https://e.test/a"), ("url", "", "https://e.test/b"), ("url", "<p>x</p>", "nourl")]
    got = {(r.kind, r.locator, r.rejected): r for r in ingest.ingest(spark.createDataFrame(rows, "kind string, value string, label string")).collect()}
    assert got["text", "Pasted text", None].content == "Hi \\*you\\*\n"
    assert ("markdown", "m", "Markdown contains unsafe raw HTML") in got
    assert ("feed", "f", "Unsupported source kind: feed") in got
    assert ("text", "Pasted text", "Cannot ingest empty text content") in got
    assert got["url", "https://e.test/a", None].content == "Body text here."
    assert ("url", "https://e.test/b", "Could not extract article content") in got
    assert ("url", "nourl", "Invalid article URL: nourl") in got
    assert len(got) == len(rows)


def test_files(spark, tmp_path):
    for name, data in (("a.md", b"# T"), ("b.txt", b"x*"), ("c.json", b"{}"), ("d.txt", b"\xff\xfe"), ("e.md", b"a\0b"), ("F.MARKDOWN", b"ok")):
        (tmp_path / name).write_bytes(data)
    drafts = ingest.ingest_files(readers.read_files(spark, str(tmp_path), "*"))
    got = {r.title: (r.content, (r.rejected or "").split(":")[0]) for r in drafts.collect()}
    assert got == {"a": ("# T", ""), "b": ("x\\*", ""), "c": (None, "Unsupported source file type"), "d": (None, "Source file is not valid UTF-8 text"), "e": ("a\0b", "Source file appears to be binary"), "F": ("ok", "")} | {"c": ("\\{\\}", "Unsupported source file type")}


def test_capture_to_archive(spark):
    drafts = ingest.ingest_text(spark.createDataFrame([("Hello there", "A title"), ("Hello there", "A title"), (None, None)], "text string, label string"))
    src = library.source_records(drafts, NOW).dropDuplicates(["id"])
    arch = library.archive_records(src, NOW)
    assert library.archive_fidelity(arch, src).select("reason").collect() == [(None,)]
    r = arch.first()
    assert (r.slug, r.body.path) == ("a-title", f"articles/archive/{r.id}/content.md")
    assert library.source_records(drafts, NOW).first().id == src.first().id  # the same on every run


def test_fonts(spark):
    samples = [("a", "Georgia", 80), ("a", "Inter, serif", 200), ("b", "Unknown", 900), ("c", "'Source Sans Pro'", 5000), ("c", "Noto Serif", 1000), ("d", None, None)]
    got = {r.id: r.style for r in fonts.vote(spark.createDataFrame(samples, "id string, fontFamily string, textLength int")).collect()}
    assert got == {"a": "sans-serif", "b": "serif", "c": "serif", "d": "serif"}


def test_frontmatter(spark):
    a = spark.createDataFrame([article(authors=None)], ARTICLE).withColumns({"canonicalUrl": F.lit("https://e.test/1"), "urls": F.array(F.lit("https://e.test/1")), "published": F.array(F.lit("2024"), F.lit("2025")), "sourceAuthors": F.array(F.lit("Ada"))})
    text = vault.frontmatter(a, ("#x", "x", " "), {"kind": "1"}).first().frontmatter
    assert text.startswith('---\n"kind": 1\n"articleId": "art_')
    assert '"title": "Say \\"hi\\""\n' in text
    assert '"publishedAt": ["2024","2025"]\n"generatedBy": "p/m"\n"tags": ["x"]\n---\n\n' in text
    with pytest.raises(ValueError, match="reserved"):
        vault.frontmatter(a, (), {"title": "1"})
    md = spark.createDataFrame([("---\na: \"x: y\"\nb: 2\na: 3\nnone\n---\nbody",), ("no",), (None,), ("---\nopen",)], "m string")
    assert [r[0] for r in md.select(vault.parse_frontmatter(F.col("m"))).collect()] == [{"b": "2", "a": "3"}, {}, {}, {}]


def test_note_names(spark):
    a = spark.createDataFrame([article()], ARTICLE)
    assert a.select(vault.note_name("{{date}} {{ title }}")).first()[0] == "2026-01-01 Say -hi-"
    for bad in ("{{nope}}", "{{title", "a}}"):
        with pytest.raises(ValueError, match="note"):
            vault.note_name(bad)


def test_vault(spark):
    planned = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, contents string")
    there = spark.createDataFrame([("b", "2"), ("c", "x"), ("z", "y")], "path string, contents string")
    assert {r.path: r.status for r in vault.diff(planned, there).collect()} == {"a": "missing", "b": "unchanged", "c": "conflict"}
    with pytest.raises(FileExistsError, match="c"):
        vault.changes(planned, there)
    assert {r.path for r in vault.changes(planned, there, overwrite=True).collect()} == {"a", "c"}


def test_assets(spark):
    bodies = spark.createDataFrame([("a", "![x](p/My%20pic.png) ![y](q.jpg) ![z](p/My%20pic.png)"), ("b", None)], "article_id string, body string")
    refs = bodies.select("article_id", F.explode(vault.image_references(F.col("body"))).alias("r")).select("article_id", "r.start", "r.target")
    assets = spark.createDataFrame([("p/My%20pic.png", "image/png", b"1"), ("q.jpg", "text/plain", b"1")], "target string, mediaType string, contents binary")
    plan = vault.plan_assets(refs, assets, spark.createDataFrame([("a", "s")], "article_id string, slug string"))
    got = {r.target: (r.n, r.export_name, r.rejected) for r in plan.collect()}
    assert got == {"p/My%20pic.png": (1, "001-My-pic.png", None), "q.jpg": (2, None, "unsupported media type")}
    out = {r.article_id: r.body for r in vault.rewrite_images(bodies, plan).collect()}
    assert out == {"a": "![x](attachments/s/001-My-pic.png) ![y](q.jpg) ![z](attachments/s/001-My-pic.png)", "b": None}


def test_local_images(spark):
    refs = spark.createDataFrame([("a", "p%20q.png"), ("a", "../up.png"), ("a", "https://e.test/x.png"), ("a", "file:///abs/z.png"), ("b", "p.png"), ("c", "p.png")], "article_id string, target string")
    a = spark.createDataFrame([("a", ["f1", "u"]), ("b", ["f1", "f2"]), ("c", ["u"])], "id string, sourceIds array<string>")
    src = spark.createDataFrame([("f1", "file", "/in/d/n.md"), ("f2", "file", "/in/m.md"), ("u", "url", "/x")], "id string, kind string, l string").select("id", "kind", F.struct(F.col("l").alias("locator")).alias("origin"))
    files = spark.createDataFrame([("/in/d/p q.png", "image/png", b"1"), ("/in/up.png", "image/png", b"2")], "path string, mediaType string, contents binary")
    got = vault.local_assets(refs, a, src, files)
    assert {(r.article_id, r.target): r.rejected for r in got.collect()} == {("a", "p%20q.png"): None, ("a", "../up.png"): None, ("a", "file:///abs/z.png"): "no such image file", ("b", "p.png"): "needs exactly one file source", ("c", "p.png"): "needs exactly one file source"}
    bodies = spark.createDataFrame([("a", "![x](p%20q.png) ![y](https://e.test/x.png)")], "article_id string, body string")
    own = bodies.select("article_id", F.explode(vault.image_references(F.col("body"))).alias("r")).select("article_id", "r.start", "r.target")
    plan = vault.plan_assets(own, got.where("rejected is null"), spark.createDataFrame([("a", "s l")], "article_id string, slug string"), "files/img")
    assert vault.rewrite_images(bodies, plan, "files/img", "notes/in").first().body == "![x](../../files/img/s%20l/001-p-q.png) ![y](https://e.test/x.png)"


def test_exports(spark):
    a, s = frames(spark, [article(description="D <x>")], [source()])
    bodies = spark.createDataFrame([(article()["id"], "# T\n\nText [^cite_a] & more<br>x\n\n```\ncode\n```\n")], "id string, body string")
    md = export.markdown_export(a, bodies, s).first().artifact
    assert md.startswith('---\narticleId: "art_')
    assert md.endswith("— “q <x>”\n")
    html = export.html_export(a, bodies, s).first()
    assert '<p class="article-description">D &lt;x&gt;</p>' in html.artifact
    assert '<a href="#cite_a">[1]</a>' in html.artifact
    epub = export.epub_export(a, bodies, s)
    data = bytes(epub.first().epub)
    assert data == bytes(epub.first().epub)
    v = export.validate_epub(epub).first()
    assert (v.problem, v.manifestItems, v.spineItems, v.embeddedAssets, len(v.files)) == (None, 3, 1, 0, 6)
    assert zipfile.ZipFile(BytesIO(data)).namelist()[0] == "mimetype"
    rec = export.export_records(export.markdown_export(a, bodies, s), "markdown", NOW)
    assert checks.check(rec.withColumn("delivery", F.lit(None).cast("struct<confirmedAt:string,confirmationMethod:string,deliveredAt:string>")), checks.export_rules()).first().violations == []
    p = export.delivery_preview(rec, a, "reader@kindle.com", "me@mail.test").first()
    assert (p.recipient, p.filename) == ("r*****@kindle.com", "say-hi.markdown")
    for bad in ("reader@mail.test", "kindle.com", "a b@kindle.com"):
        with pytest.raises(ValueError, match="recipient"):
            export.delivery_preview(rec, a, bad, "me@mail.test")


def repacked(data, change=(), without=(), stored=True):
    """The package with parts changed or left out."""
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for name in z.namelist():
            if name not in without:
                w.writestr(name, dict(change).get(name, z.read(name)), zipfile.ZIP_STORED if name == "mimetype" and stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_packages_with_images_and_faults(spark):
    a, s = frames(spark, [article()], [source()])
    bodies = spark.createDataFrame([(article()["id"], "![x](https://e.test/p.png) ![y](q.jpg) ![x](https://e.test/p.png)\n\n```\n![z](z.png)\n```\n")], "id string, body string")
    assets = spark.createDataFrame([("https://e.test/p.png", "image/png", b"\x89PNG..."), ("q.jpg", "text/plain", b"1"), ("z.png", "image/png", b"2")], "target string, mediaType string, contents binary")
    epub = export.epub_export(a, bodies, s, assets=assets)
    data = bytes(epub.first().epub)
    v = export.validate_epub(epub).first()
    assert (v.problem, v.manifestItems, v.embeddedAssets) == (None, 4, 1)
    with zipfile.ZipFile(BytesIO(data)) as z:
        assert z.read("EPUB/assets/001-p.png") == b"\x89PNG..."
        assert z.read("EPUB/article.xhtml").count(b'src="assets/001-p.png"') == 2
        opf = z.read("EPUB/package.opf")
    faults = {
        "cannot be read": data[: len(data) // 2], "first entry": repacked(data, stored=False), "required entry EPUB/nav.xhtml": repacked(data, without=["EPUB/nav.xhtml"]), "not that of a package": repacked(data, {"mimetype": b"text/plain"}.items()),
        "malformed XML in EPUB/nav.xhtml": repacked(data, {"EPUB/nav.xhtml": b"<nav>"}.items()), "another package": repacked(data, {"META-INF/container.xml": b"<container/>"}.items()), "tell its title": repacked(data, {"EPUB/package.opf": opf.replace(b"dc:title", b"dc:name")}.items()),
        "is the navigation": repacked(data, {"EPUB/package.opf": opf.replace(b'properties="nav"', b"")}.items()), "spine is empty": repacked(data, {"EPUB/package.opf": opf.replace(b'<itemref idref="article"/>', b"")}.items()),
        "not there: EPUB/assets/001-p.png": repacked(data, without=["EPUB/assets/001-p.png"]), "item that is not there: lost": repacked(data, {"EPUB/package.opf": opf.replace(b'idref="article"', b'idref="lost"')}.items()), "cannot be read as": None, "archive:": b"",
    }
    got = {r.id: r.problem for r in export.validate_epub(spark.createDataFrame(list(faults.items()), "id string, epub binary")).collect()}
    assert all(k in got[k] for k in faults), got


def test_a_changed_archive_is_not_exported(spark):
    a = spark.createDataFrame([("x", "archive", "sha256:1"), ("y", "archive", "sha256:2"), ("z", "digest", "sha256:3")], "id string, mode string, h string").select("id", "mode", F.struct(F.col("h").alias("textHash")).alias("body"))
    made = spark.createDataFrame([("x", "X", "sha256:1"), ("y", "Y", "sha256:0"), ("z", "Z", None)], "id string, artifact string, text_hash string")
    assert {r.id: r.artifact for r in export.faithful(a, made).collect()} == {"x": "X", "y": None, "z": "Z"}


def test_vault_writes(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, contents binary")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/old.md").write_text("old")
    tree = lambda: {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    before = tree()
    write = writers.VaultWrite(files(("in/old.md", b"new"), ("at/a b.md", b"1")), str(tmp_path)).apply()
    assert (tmp_path / "in/old.md").read_text() == "new"
    write.rollback()
    assert tree() == before
    write = writers.VaultWrite(files(("in/old.md", b"new"), ("at/a b.md", b"1")), str(tmp_path)).apply()
    write.commit()
    assert tree() == {"in/old.md": "new", "at/a b.md": "1"}
    assert {(r.path, bytes(r.contents)) for r in readers.read_tree(spark, str(tmp_path)).collect()} == {("in/old.md", b"new"), ("at/a b.md", b"1")}
    (tmp_path / "dir").mkdir()
    for bad in ("dir", "../out.md"):
        with pytest.raises(Exception, match="not a file of the vault"):
            writers.VaultWrite(files(("in/old.md", b"newer"), (bad, b"x")), str(tmp_path)).apply()
        assert tree() == {"in/old.md": "new", "at/a b.md": "1"}


def test_manifests_and_slugs(spark, tmp_path):
    rec = spark.createDataFrame([("src_1", "é", None)], "id string, title string, kind string")
    writers.write_manifests(rec, str(tmp_path), F.concat(F.lit("sources/"), F.col("id")))
    writers.write_manifests(rec, str(tmp_path), F.concat(F.lit("sources/"), F.col("id")))
    assert (tmp_path / "sources/src_1/manifest.json").read_text() == '{\n  "id": "src_1",\n  "title": "é"\n}\n'
    with pytest.raises(Exception, match="file exists"):
        writers.write_manifests(rec.withColumn("title", F.lit("x")), str(tmp_path), F.concat(F.lit("sources/"), F.col("id")))
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "file.md").write_text('---\nslug: "own-slug"\ntitle: "T"\n---\nx')
    (notes / "plain.md").write_text("x")
    (notes / "Not Safe.md").write_text("x")
    texts = readers.read_markdown(spark, str(notes))
    assert {(r.slug, r.title) for r in readers.page_list(texts).collect()} == {("own-slug", "T"), ("plain", "plain")}
    assert readers.read_markdown(spark, str(notes), ["plain"]).count() == 1


def test_rendered_samples(spark):
    long = "x" * 40
    p = spark.createDataFrame([("a", long + "1", "Inter", ["body p"]), ("a", long + "22", "Lora", ["article p", "body p"]), ("a", "short", "Lora", ["article p"]), ("b", long + "hit", "Inter", ["body p"]), ("b", long, "Lora", ["article p"]), ("c", long, "Lora", [])], "id string, text string, fontFamily string, scopes array<string>")
    e = spark.createDataFrame([("b", "hit")], "id string, text string")
    assert {(r.id, r.fontFamily, r.textLength) for r in fonts.rendered_samples(p, e).collect()} == {("a", "Lora", 42), ("b", "Inter", 43)}
    assert fonts.rendered_samples(p.withColumn("text", F.lit(long)), e, most=1).where("id = 'a'").count() == 1


def test_empty_tables(spark):
    a, s, e = (spark.createDataFrame([], x) for x in (ARTICLE, SOURCE, EXPORT))
    bodies = spark.createDataFrame([], "id string, body string")
    for df in (library.archive_fidelity(a, s), citations.orphan_citations(a, s), citations.footnotes(a, s), export.html_export(a, bodies, s), export.epub_export(a, bodies, s), checks.duplicate_ids(s), library.list_articles(a)):
        assert df.count() == 0
    assert checks.check(e, checks.export_rules()).count() == 0


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, mode string")
    path = f"file://{tmp_path}/t"
    writers.append_new(rec, path, "mode")
    with pytest.raises(FileExistsError):
        writers.append_new(rec, path, "mode")
    with pytest.raises(FileExistsError):
        writers.append_new(spark.createDataFrame([("c", "x"), ("c", "y")], "id string, mode string"), path, "mode")
    assert readers.find_record(readers.read_table(spark, path), "a").count() == 1
    with pytest.raises(Exception, match="exists"):
        writers.create_table(rec, path)
    writers.write_files(spark.createDataFrame([("n/a.md", "é")], "path string, contents string"), str(tmp_path / "v"))
    assert (tmp_path / "v/n/a.md").read_text() == "é"
    assert {r.slug for r in readers.read_markdown(spark, str(tmp_path / "v/n")).collect()} == {"a"}
    assert not writers.inside_git_tree(str(tmp_path))


def test_manifests(spark, tmp_path):
    import json

    d = tmp_path / "sources/src_1"
    d.mkdir(parents=True)
    (d / "manifest.json").write_text(json.dumps(source(), indent=2) + "\n")
    assert readers.read_manifests(spark, str(tmp_path), "sources").first().origin.canonicalUrl == "https://e.test/1"


def test_stream(spark, tmp_path):
    from paperweir import streaming

    inp = tmp_path / "in"
    inp.mkdir()
    (inp / "1.json").write_text('{"text":"a","label":"l","ts":"2026-01-01T00:00:00Z"}\n{"text":"a","label":"l","ts":"2026-01-01T00:01:00Z"}\n{"text":" ","label":"l","ts":"2026-01-01T00:02:00Z"}\n')
    run = lambda: streaming.write_stream(streaming.stream_sources(spark, str(inp), "text string, label string, ts timestamp", NOW), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (inp / "2.json").write_text('{"text":"a","label":"l","ts":"2026-01-01T00:03:00Z"}\n{"text":"b","label":"l","ts":"2026-01-01T00:04:00Z"}\n')
    run()
    assert sorted(r.contentText for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
