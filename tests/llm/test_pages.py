"""Main content, encodings, residue and site lines."""

import time

import pytest

from paperweir.llm import mainbody, mojibake, residue, sitelines

PAGE = """<html lang="en"><body><div id="top"><ul><li><a href="/">Home</a></li></ul><p>We use cookies to count visits.</p></div>
<div id="content"><h1>{title}</h1><!-- <p>old</p> --><script>document.write("<p>no</p>")</script><p class="byline">By Ada Kock</p>
<p>{a} had been mended, and the drivers said so, twice a week.</p><h2>Why {a}</h2><p>{b} was kept, though the council, in the end, did not ask.</p>
<ul><li>First of {a}</li><li>Second of {b}</li></ul><p>Thank you for reading.</p><div id="side"><p>Other {b} news, from the back room.</p></div></div>
<div id="foot"><p>© 2024 Site</p></div></body></html>"""


def pages(spark, n=12):
    rows = [(f"p{i}", "site", PAGE.format(title=f"Title {'abcdefghijkl'[i]}", a=f"Gate {'abcdefghijkl'[i]} of Hofmus", b=f"Lamp {'abcdefghijkl'[i]} in Gadnel"), None) for i in range(n)]
    rows += [("null", "site", None, None), ("empty", None, "", None), ("bare", None, "no tags", None), ("error", "site", "<body><h1>404 Not Found</h1><p>The requested URL was not found on this server.</p></body>", "<p>x")]
    return spark.createDataFrame(rows, "id string, site string, raw string, clean string")


def found(pages, views):
    return mainbody.main_blocks(pages.select("id", *views), views, pages.select("id", "site")).collect()


def test_main_blocks(spark):
    got = {}
    for r in found(pages(spark), ["raw", "clean"]):
        got.setdefault((r.id, r.view), set()).add(r.block_no)
    # 1 nav item, 2 cookies, 3 title, 4 byline, 5 text, 6 subhead, 7 text, 8 and 9 items, 10 thanks, 11 side, 12 footer
    assert {k[0] for k in got} == {f"p{i}" for i in range(12)}
    assert all(v == {3, 5, 6, 7, 8, 9} for v in got.values())


def test_copies_of_an_article_are_no_standing_lines(spark):
    text = "was mended twice a week, as the drivers of the upper valley had asked in vain for years, and the council paid, in the end."
    page = "<body><div id=top><p>We use cookies to count visits.</p></div><div id=content><h1>{0} opens</h1><p>{0} {1}</p><p>In {0}, the lamp {1}</p><p>Thank you for reading.</p></div></body>"
    rows = [(f"p{c}", "s", page.format(f"Gate {c} of Hofmus", text)) for c in "abcdefghijkl"] + [(f"copy{k}", "s" if k % 2 else f"s{k}", page.format("The old pier", text)) for k in range(16)]
    got = {}
    for r in found(spark.createDataFrame(rows, "id string, site string, raw string"), ["raw"]):
        got.setdefault(r.id, set()).add(r.block_no)
    assert set(got) == {r[0] for r in rows}
    assert {2, 3, 4} <= set.intersection(*got.values())
    assert all(5 not in v for i, v in got.items() if i[0] == "p")


def test_long_pages_of_brief_items_are_no_message():
    long = "The bridge was mended twice a week, as the drivers had asked in vain for years, and the council paid in the end. " * 4
    assert not mainbody.is_message(["Gate"] * 40 + [long, "The ferry ran with the permission of the owner."])
    assert mainbody.is_message(["Access denied", "You do not have permission to see this."])


def test_blocks_of_malformed_pages():
    blocks, _ = mainbody.read_blocks("<p>a<p>b<ul><li>c<li>d</ul><blockquote><p>e</blockquote><pre>f</pre><h2>g<p class='x>y'>h <!-- <p> --> <script><p></script>")
    assert [b.tag for b in blocks] == ["p", "p", "li", "li", "blockquote", "p", "pre", "h2", "p"]
    assert [b.own for b in blocks] == ["a", "b", "c", "d", "", "e", "f", "g", "h"]
    assert mainbody.read_blocks("<p>" * 5000)[0][-1].tag == "p"


@pytest.mark.parametrize("page", ["<div>" * 10_000 + "<p>x", '<a href="' * 20_000, "<p " * 20_000, "<!--" * 20_000, "<script" * 20_000, "<p class='" * 10_000 + ">x", '<a b="<a b=\'' * 10_000 + ">", "</p" + " " * 50_000 + "</script " * 9_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    blocks, containers = mainbody.read_blocks(page)
    mainbody.select_content(blocks, containers)
    assert time.perf_counter() - began < 2


def test_paths_merge_elements_of_the_same_names():
    """The parts of an article in boxes of one kind are one path."""
    part = "<div class=part><p>The gate was mended, as the drivers had asked, twice a week.</p></div>"
    blocks, containers = mainbody.read_blocks(f"<body><div class=menu><p>Menu</p></div><div class=story>{part * 3}<div class=part><p>Yes.</p></div></div></body>")
    mainbody.select_content(blocks, containers)
    assert [b.main for b in blocks] == [False, True, True, True, True]


def test_empty_pages(spark):
    assert found(spark.createDataFrame([], "id string, site string, raw string"), ["raw"]) == []


CLEAN = {"de": "über für schön Straße Brücke Müller während größer", "fr": "à côté été déjà l’île château fenêtre – après", "ru": "город река школа станция молчит возле против старый мост", "cs": "čeká přístav střechou řeka škola příští"}


def test_encodings(spark):
    rows = [(f"{lang}{i}", "rawHtml", f'<html lang="{lang}"><p>{text}</p>') for lang, text in CLEAN.items() for i in range(8)]
    bad = {
        "b1": "Brücke – Straße".encode().decode("cp1252"),
        "b2": "l’île déjà".encode().decode("cp1252").encode().decode("cp1252"),
        "b3": "станция молчит".encode("cp1251").decode("cp1252"),
        "b4": "fenêtre".encode().decode("mac_roman"),
        "b5": "&#xC3;&#xA9;t&#195;&#169;",
        "b6": "lost � here",
        "b7": "школа река".encode("koi8_r").decode("cp1251"),
        "b8": "přístav čeká".encode("cp1250").decode("cp1252"),
    }
    rows += [(k, "title", v) for k, v in bad.items()] + [("n", "title", None), ("e", "title", ""), ("a", "title", "plain &amp; ascii"), ("q", "title", "“Quoted” – it’s fine… ©"), ("b1", "title", bad["b1"])]
    r = mojibake.Repair(spark.createDataFrame([(*x, 1) for x in rows], "id string, field_name string, text string, word int"))
    assert {x.id for x in r.found().collect()} == set(bad)
    restored = {x.id: x.restored for x in r.restored().collect()}
    assert restored["b1"] == "Brücke – Straße"
    assert restored["b2"] == "l’île déjà"
    assert restored["b3"] == "станция молчит"
    assert restored["b5"] == "été"
    assert restored["b7"] == "школа река"
    assert restored["b6"] == bad["b6"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_every_multibyte_chain_round_trips(codec):
    for text in ("é", "–", "école", "Größe"):
        try:
            garbled = text.encode().decode(codec)
        except UnicodeDecodeError:
            continue
        assert text in [t for t, _, _ in mojibake.candidates(garbled)]


def test_long_chains_are_followed_to_their_end():
    text = "é"
    for _ in range(5):
        text = text.encode().decode("latin-1")
    assert "é" in [t for t, _, _ in mojibake.candidates(text)]


def test_no_records_to_repair(spark):
    assert mojibake.Repair(spark.createDataFrame([], "id string, field_name string, text string")).found().count() == 0


GOOD = [
    "The word undefined appears in the charter of Tokfovfib more often than any number.",
    "She keeps a list of the best 404 pages, Gadnel first among them.",
    "A site that says scripts are required shuts out the readers of Hofmus, the librarians argued.",
    "See [the gate](https://e.test/a_b) and the *index* of 12 parts.",
    "Costs rose from 12 to 50 crowns; nothing was null and void.",
    "Whoops and cheers rang out in the hall when the mayor came.",
    "Oops was the name of their first album, and few bought it.",
    "Just a moment of silence was held in Gadnel.",
]
BAD = [
    "Dear {{ reader.first_name }}, this part is for you.", "In [CITY NAME] the count stood at [NUMBER].", "Hello %%FIRSTNAME%%, here it is.", "Please enable JavaScript to view the chart below.", "TK: add quote from the council here.",
    "Ce site requiert JavaScript pour fonctionner.", "Oops! That page is gone.", "Just a moment...", "undefined said that the work was done by null.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "You must have scripts enabled to see this poll.", "Figures as of $DATE$ from $SOURCE$.", "${post.title}", "404 Not Found", "Seite nicht gefunden",
]


@pytest.mark.parametrize("unit", GOOD)
def test_ordinary_units(unit):
    assert residue.judge(unit + " More text follows.", True, [])[0] == []


@pytest.mark.parametrize("unit", BAD)
def test_residual_units(unit):
    assert residue.judge("A first line of text.\n\n" + unit, True, [])[0]


def test_residue(spark):
    code = "greeting = 'Dear {{name}}'"
    rows = [
        ("code", f"Text before. {code} Text after.", f"Text before.\n\n```\n{code}\n```\n\nText after.", f"<p>Text before.</p><pre><code>{code}</code></pre><p>Text after.</p>"),
        ("both", "Access denied Reference #12", "# Access denied\n\nReference #12", "<h1>Access denied</h1>"),
        ("body", "An ordinary text.", "An ordinary text.\n\n<%= related_links(3) %>", "<p>An ordinary text.</p>"),
        ("flat", "A heading You must have scripts enabled to see this poll. And so on.", None, None),
        ("null", None, None, None), ("empty", "", "  ", ""),
        *[(f"rep{i}", f"Out to lunch, back at {i} sharp", None, None) for i in range(residue.REPEATED)],
        ("once", "A lone short line", None, None),
    ]
    r = residue.Residue(spark.createDataFrame([(*x, "y") for x in rows], "id string, text string, body string, html string, units string"))
    got = {(x.id, x.field_name) for x in r.found().collect()}
    assert got == {("both", "sourceText"), ("both", "body"), ("body", "body"), ("flat", "sourceText")} | {(f"rep{i}", "sourceText") for i in range(residue.REPEATED)}
    assert {x.template for x in r.templates().collect()} >= {"▯"}


@pytest.mark.parametrize("bad", ["Dear , this part of the letter is for you.", "Dear {0}, this part of the letter is for you.", "Dear %(name)s, this part of the letter is for you.", "Dear nil, this part of the letter is for you."])
def test_slots_are_induced_from_recurring_units(spark, bad):
    people = ["Anna", "Bo", "Cyril", "Dora", "Emil", "Fay", "Gus", "Hana", "Ivo", "Jan"]
    filler = " ".join(f"word{k}" for k in range(70)) + ". "
    rows = [(f"p{k}", filler + f"Dear {p}, this part of the letter is for you.", None, None) for k, p in enumerate(people)]
    # one text copied is no slot, and what stands under no recurring frame is ordinary
    rows += [(f"c{k}", filler + "Dear Kim, that copy of the letter is old.", None, None) for k in range(10)] + [("c", filler + "Dear , that copy of the letter is old.", None, None)]
    rows += [("alone", filler + "Dear {0}, such words were read nowhere else.", None, None), ("bad", filler + bad, None, None)]
    got = {x.id for x in residue.Residue(spark.createDataFrame(rows, "id string, text string, body string, html string")).found().collect()}
    assert "bad" in got
    assert not got - {"bad", "alone"}


def test_copies_of_a_short_text_are_no_repeated_page(spark):
    n = residue.REPEATED
    rows = [(f"copy{k}", "The ferry ran again from the old pier.", "The ferry ran *again* from the old pier.", None) for k in range(n)]
    rows += [(f"name{k}", f"{w} Kovarik", None, None) for k, w in enumerate(["Annabel", "Bertram", "Cyprian", "Dorothea", "Emilian", "Felicia", "Gustava", "Hannelore"])]
    rows += [(f"rep{k}", f"Out to lunch, back at {k} sharp", None, None) for k in range(n)]
    got = {x.id for x in residue.Residue(spark.createDataFrame(rows, "id string, text string, body string, html string")).found().collect()}
    assert got == {f"rep{k}" for k in range(n)}


def test_site_lines(spark):
    rows = [(f"d{i}", "s", f"Story {'abcdefgh'[i]} of the gate\nSUBSCRIBE  to the letter {i}\nshort\n\r\nOnly here {'abcdefgh'[i]} today", "2024") for i in range(8)]
    rows += [("copy", "s", rows[0][2], None), ("other", "t", "Subscribe to the letter 1", None), ("null", "s", None, None), ("none", None, "Subscribe to the letter 1", None), ("empty", "s", "", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "id string, site string, body string, date string, cut int")
    want = {(f"d{i}", 2) for i in range(8)} | {("copy", 2)}
    lines = sitelines.placed_lines(docs, docs.select("id", "site"))
    assert {(r.id, r.line_no) for r in sitelines.standing_lines(lines).collect()} == want
    clean = {r.id: r.clean_body for r in sitelines.cut_standing_lines(docs, lines).collect()}
    assert clean["d1"] == "Story b of the gate\nshort\n\r\nOnly here b today"
    assert (clean["null"], clean["empty"], clean["other"]) == (None, "", "Subscribe to the letter 1")
    assert len(clean) == len(rows)
    stats = sitelines.line_statistics(lines).orderBy(sitelines.F.desc("n_bodies")).first()
    assert (stats.n_bodies, stats.n_clusters, stats.n_dates, stats.site_bodies) == (9, 8, 1, 10)
    none = docs.limit(0)
    assert sitelines.standing_lines(sitelines.placed_lines(none, none.select("id", "site"))).count() == 0
