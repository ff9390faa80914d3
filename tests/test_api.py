import json

import pytest

from paperweir import config
from paperweir.api import Library

NOW = "2026-01-01T00:00:00.000Z"


def test_library(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", NOW)
    rows = [("text", "Some plain text.", "A title"), ("text", "Other text.", "A title"), ("markdown", "# T\n\nBody.", "Notes"), ("text", " ", None), ("url", "<article><p>Words of a page.</p></article>", "https://e.test/a")]
    df = spark.createDataFrame(rows, "kind string, value string, label string")
    saved, rejected = lib.ingest(df)
    assert (saved.count(), rejected.count()) == (4, 1)
    assert sorted(r.slug for r in saved.collect()) == ["a-title", "a-title-2", "notes", "untitled-article"]
    again, _ = lib.ingest(spark.createDataFrame([*rows, ("text", "Third.", "A title")], "kind string, value string, label string"))
    assert [r.slug for r in again.collect()] == ["a-title-3"]
    assert lib.list(3).count() == 3
    sid = lib.table("sources").where("title = 'Notes'").first().id
    assert lib.show(sid).count() == 1
    with pytest.raises(ValueError, match="Invalid record"):
        lib.show("nope")
    for fmt in ("markdown", "html", "epub"):
        assert lib.export(fmt).where("artifact is not null").count() == 5
    with pytest.raises(ValueError, match="Unsupported"):
        lib.export("pdf")
    c = "id string, mode string, title string, body string, sourceIds array<string>, citations array<struct<id:string,sourceId:string,quote:string>>, slug string, generatedBy struct<provider:string,model:string,thinkingLevel:string,sessionId:string,generatedAt:string>"
    by = ("p", "m", None, None, NOW)
    drafts = [
        ("ok", "digest", " Notes ", "x [^cite_1]", [sid, sid], [("cite_1", sid, "q")], None, by),
        ("named", "synthesis", "Other", "y [^cite_1]", [sid], [("cite_1", sid, None)], "own-slug", by),
        ("taken", "synthesis", "Other", "z [^cite_1]", [sid], [("cite_1", sid, None)], "notes", by),
        ("bad", "archive", " ", "x [^cite_2]", ["src_x"], [("cite_1", sid, None), ("cite_1", sid, None)], "Un safe", by),
    ]
    good, bad = lib.save_generated(spark.createDataFrame(drafts, c))
    assert {(r.title, r.slug, tuple(r.sourceIds)) for r in good.collect()} == {("Notes", "notes-2", (sid,)), ("Other", "own-slug", (sid,))}
    assert {r.id: len(r.reasons) for r in bad.collect()} == {"taken": 1, "bad": 8}
    assert lib.save_generated(spark.createDataFrame(drafts[:1], c))[0].count() == 0
    aid = good.where("slug = 'own-slug'").first().id
    assert lib.load(aid).first().contentText == "y [^cite_1]"
    assert lib.load(sid).first().title == "Notes"
    assert lib.verify().count() == 0
    with pytest.raises(KeyError):
        lib.load("art_none")
    html = lib.export("html").where(f"id = '{aid}'").first().artifact
    assert ">[1]</a>" in html
    assert lib.publish("markdown").count() == 7
    assert lib.publish("markdown").count() == 0
    assert lib.table("artifacts").count() == 7
    (tmp_path / "vault").mkdir()
    sent = lib.deliver_to_vault(str(tmp_path / "vault"), "V", "inbox", "{{slug}}")
    assert {r.destination.notePath for r in sent.collect()} == {f"inbox/{r.slug}.md" for r in lib.table("articles").collect()}
    assert "[^cite_1]: " in (tmp_path / "vault/inbox/own-slug.md").read_text()
    (tmp_path / "vault/inbox/own-slug.md").write_text("edited")
    with pytest.raises(FileExistsError, match="own-slug"):
        lib.deliver_to_vault(str(tmp_path / "vault"), "V", "inbox", "{{slug}}")
    assert (tmp_path / "vault/inbox/own-slug.md").read_text() == "edited"
    lib.deliver_to_vault(str(tmp_path / "vault"), "V", "inbox", "{{slug}}", overwrite=True)
    assert "edited" not in (tmp_path / "vault/inbox/own-slug.md").read_text()


def test_what_was_altered_in_store_is_found(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", NOW)
    saved, _ = lib.ingest(spark.createDataFrame([("text", "One.", "A"), ("text", "Two.", "B")], "kind string, value string, label string"))
    aid = saved.where("title = 'A'").first().id
    changed = [(r.id, r.body + "x" if r.id == aid else r.body) for r in lib.table("contents").collect()]
    spark.createDataFrame(changed, "id string, body string").write.mode("overwrite").parquet(f"file://{tmp_path}/lib/contents")
    assert [r.id for r in lib.verify().collect()] == [aid]
    with pytest.raises(ValueError, match="content hash"):
        lib.load(aid)
    assert {r.id for r in lib.export("html").where("artifact is null").collect()} == {aid}


def test_commands(spark, tmp_path, capsys):
    from paperweir.__main__ import main

    (tmp_path / "in.json").write_text('{"kind":"text","value":"One.","label":"A"}\n{"kind":"text","value":" ","label":"B"}\n{"kind":"fax","value":"x","label":"C"}\n')
    root = f"file://{tmp_path}/lib"
    run = lambda *a: (main([root, "--now", NOW, *a], spark), capsys.readouterr().out)
    assert run("read", str(tmp_path / "in.json")) == (0, "1 saved\n1 rejected: Cannot ingest empty text content\n1 rejected: Unsupported source kind: fax\n")
    code, out = run("list")
    assert (code, out.split("  ")[-1]) == (0, "A\n")
    assert f'"id":"{out.split()[0]}"' in run("show", out.split()[0])[1]
    assert run("publish", "markdown") == (0, "1 published\n")
    assert run("render", "html", str(tmp_path / "out"))[0] == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert run("verify") == (0, "0 faults\n")


def test_no_library_in_a_working_tree(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    with pytest.raises(ValueError, match="Git"):
        Library(spark, f"file://{tmp_path}/lib", NOW)
    assert Library(spark, f"file://{tmp_path}/lib", NOW, allow_git=True).table("exports").count() == 0


def test_config(tmp_path):
    assert config.read(tmp_path / "none.json") == {"schemaVersion": 1}
    path = tmp_path / "c" / "paperweir.json"
    config.update(path, "obsidian", {"vaultPath": "~/V", "tags": ["a"]})
    config.update(path, "libraryDir", "lib")
    r = config.resolve(str(path), env={}, home="/home/u", cwd="/w")
    assert str(r.library_dir) == str(tmp_path / "c" / "lib")
    assert r.config["obsidian"]["vaultPath"] == "/home/u/V"
    assert r.config["obsidian"]["vaultName"] == "V"
    assert str(config.resolve(str(path), env={"PAPERWEIR_LIBRARY_DIR": "x"}, home="/home/u", cwd="/w").library_dir) == "/w/x"
    assert str(config.resolve(str(path), "y", env={"PAPERWEIR_LIBRARY_DIR": "x"}, home="/home/u", cwd="/w").library_dir) == "/w/y"
    assert str(config.resolve(env={}, home=str(tmp_path), cwd="/w").library_dir) == str(tmp_path / "Documents/paperweir")
    assert json.loads(path.read_text())["schemaVersion"] == 1


@pytest.mark.parametrize(
    ("doc", "said"),
    [
        ([], "JSON object"), ({}, "required"), ({"schemaVersion": 2}, "must be 1"), ({"schemaVersion": 1, "x": 1}, "unsupported property x"), ({"schemaVersion": 1, "libraryDir": " "}, "non-empty"),
        ({"schemaVersion": 1, "defaults": {"mode": "x"}}, "one of"), ({"schemaVersion": 1, "obsidian": {}}, "vaultPath is required"), ({"schemaVersion": 1, "obsidian": {"vaultPath": "v", "inboxFolder": "../x"}}, "unsafe"),
        ({"schemaVersion": 1, "obsidian": {"vaultPath": "v", "noteNameTemplate": "{{x}}"}}, "variable x"), ({"schemaVersion": 1, "obsidian": {"vaultPath": "v", "tags": ["a", "a"]}}, "duplicates"),
        ({"schemaVersion": 1, "obsidian": {"vaultPath": "v", "frontmatter": {"title": 1}}}, "reserved"), ({"schemaVersion": 1, "kindle": {"smtp": {"port": 70000}}}, "65535"), ({"schemaVersion": 1, "kindle": {"smtp": {"host": "a@b"}}}, "hostname"),
        ({"schemaVersion": 1, "kindle": {"recipientEnv": "lower"}}, "uppercase"),
    ],
)
def test_bad_config(doc, said):
    with pytest.raises(ValueError, match=said):
        config.check(doc)


def test_home_paths():
    assert str(config.expand("~", "/b", "/h")) == "/h"
    assert str(config.expand("a/../c", "/b", "/h")) == "/b/c"
    with pytest.raises(ValueError, match="home-relative"):
        config.expand("~other/x", "/b", "/h")
