import re
import time

import pytest

from paperweir.functions.articles import clean_content, extract, inferred_language, markdown_from_html, normalize, repeats_opening
from paperweir.functions.dom import parse_html, text_for_hash
from paperweir.functions.markdown import code_ranges, image_references, to_html, visible_text

PAGE = """<!doctype html><html><head><title>Fallback</title><link rel="canonical" href="/essay?utm_source=x&amp;id=7">
<meta property="og:title" content="A Measured Essay"><meta name="author" content="Ada Kockivvaf"><meta name="description" content="By Ada Kockivvaf">
<meta property="article:published_time" content="2024-05-01"></head><body><nav><a href="/">Home</a></nav><article><h1>A Measured Essay</h1>
<p>By <a href="/ada">Ada Kockivvaf</a></p><h2>Contents</h2><ul><li><a href="#one">One</a></li><li><a href="#two">Two</a></li></ul>
<h2 id="one">One <a class="heading-link" href="#one">Link to heading</a></h2><p>Some <strong>bold</strong><strong> text</strong> and <a href="/x?gclid=1#:~:text=q">a link</a>.</p>
<div class="highlight"><pre><code data-lang="js">let a = 1;
</code></pre></div><table><tr><td><b>Name</b></td><td><b>Value</b></td></tr><tr><td>x</td><td>1</td></tr></table>
<img src="/i.png" alt="Pic"><img alt="none"><aside>Aside</aside><script>var p = "</p>";</script></article></body></html>"""


def test_extract():
    e = extract("https://e.test/in", PAGE)
    assert (e.source_url, e.title, e.author, e.date, e.description) == ("https://e.test/essay?id=7", "A Measured Essay", "Ada Kockivvaf", "2024-05-01", "")
    for gone in ("Home", "Contents", "Aside", "heading", "By Ada", "var p", 'alt="none"'):
        assert gone not in e.cleaned_html, gone
    assert "[a link](https://e.test/x)" in e.body
    assert "```js\nlet a = 1;\n```" in e.body
    assert "<thead><tr><th>" in e.cleaned_html
    assert "**bold text**" in e.body
    assert "![Pic](https://e.test/i.png)" in e.body
    assert e.source_text == normalize(text_for_hash(parse_html(e.cleaned_html)))


def test_no_article():
    assert extract("https://e.test", "<html><body><script>x</script></body></html>") is None


def test_visible_text_of_markdown():
    assert visible_text("# Heading\n\nRead [the source](https://e.test).") == "Heading Read the source."


@pytest.mark.parametrize(
    ("md", "html"),
    [
        ("a *b* **c** `d<`", "<p>a <em>b</em> <strong>c</strong> <code>d&lt;</code></p>"),
        ("- a\n- b\n  - c", "<ul><li>a</li><li>b\n<ul><li>c</li></ul></li></ul>"),
        ("2. x\n3. y", '<ol start="2"><li>x</li><li>y</li></ol>'),
        ("> q\n> r", "<blockquote><p>q\nr</p></blockquote>"),
        ("Title\n===", "<h1>Title</h1>"),
        ("\\*no\\*", "<p>*no*</p>"),
        ("", ""),
        ("---", "<hr>"),
    ],
)
def test_markdown_to_html(md, html):
    assert to_html(md) == html


def test_markdown_of_html_and_back():
    h = "<h2>T</h2><p>a <em>b</em> &amp; c</p><ul><li>x</li><li>y</li></ul><pre><code class=\"language-py\">if a &lt; b:\n    pass</code></pre><blockquote><p>q</p></blockquote>"
    md = markdown_from_html(h)
    assert md == "## T\n\na *b* & c\n\n- x\n- y\n\n```py\nif a < b:\n    pass\n```\n\n> q"
    assert visible_text(md) == normalize(text_for_hash(parse_html(h)))


def test_bodies_of_the_data_keep_their_text(data):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{data}/web_articles.parquet", columns=["cleanedHtml", "sourceText"]).to_pylist()
    rows = [r for r in rows if r["cleanedHtml"] and r["sourceText"]]
    same = sum(normalize(text_for_hash(parse_html(r["cleanedHtml"]))) == normalize(r["sourceText"]) for r in rows)
    assert same >= 0.95 * len(rows) > 0


def test_images_outside_code():
    md = '![a](x.png "t")\n```\n![b](y.png)\n```\n<img src=\'z.png\'> ![c](<w v.png>)'
    assert [t for _, _, t in image_references(md)] == ["x.png", "z.png", "w v.png"]
    assert all(md[a:b] == t for a, b, t in image_references(md))
    assert code_ranges("a\n~~~\nopen") == [(2, 10)]


def test_code_language():
    assert inferred_language("main :: IO ()") == "haskell"
    assert inferred_language("error: no") == "text"
    assert inferred_language("x + 1") == ""


def test_description():
    assert repeats_opening("It began well", "<p></p><p>It began, well!</p><p>Then.</p>")
    assert not repeats_opening("", "<p>x</p>")


def test_odd_markup():
    for bad in ("<p>a<p>b<li>c</ul></div>", "<table><td>x<tr><td>y", "<b><i>x</b></i>", "<!-- open", "&#xD800; &bogus;", "<a href=x" + "<div>" * 200):
        html, text = clean_content(bad, "https://e.test")
        assert text == normalize(re.sub(r"\s+", " ", text))
        assert isinstance(html, str)


HOSTILE = {
    "deep": "<div>" * 10_000 + "x", "deep inline": "<span>" * 10_000 + "<p>x</p>" * 2_000, "quotes": '<a href="' * 10_000, "mixed quotes": "<a b=\"<a c='" * 5_000 + ">", "comments": "<!--" * 10_000, "less": "<" * 20_000, "ends": "</a" * 10_000,
    "declarations": "<!a" * 10_000, "scripts": "<script>" + "</script " * 10_000, "open tags": "<a b" * 10_000, "cells": "<p><table><td>" + "<span>" * 5_000 + "</p>" * 5_000, "lists": "<ul><li>" * 5_000, "emphasis": "<b>" * 2_000 + "x" + "</b>" * 2_000,
}
HOSTILE_MARKDOWN = {
    "images in links": "[![a](b)" * 2_000, "brackets": "[" * 20_000, "half links": "[a](" * 10_000, "marks": "*a " * 10_000, "mixed marks": "**a*_b" * 5_000, "unclosed marks": "_a " * 5_000 + "a* " * 5_000, "ticks": "".join("`" * (k % 99 + 1) + "a" for k in range(2_000)), "tags": "<a" * 20_000,
    "quotes": ">" * 5_000 + "x", "lists": "".join(" " * (2 * k) + "- a\n" for k in range(200)), "heading": "# " + " " * 20_000 + "x", "blanks": "- a\n" + "\n" * 10_000 + "- b", "titles": '[a](b "c' * 10_000, "fence": "``` " + " " * 20_000 + "`", "image starts": "![" * 20_000 + "](x)",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_linear_time(name):
    began = time.perf_counter()
    html, _ = clean_content(HOSTILE[name], "https://e.test")
    markdown_from_html(html)
    extract("https://e.test", HOSTILE[name])
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("name", HOSTILE_MARKDOWN)
def test_hostile_markdown_takes_linear_time(name):
    began = time.perf_counter()
    visible_text(HOSTILE_MARKDOWN[name])
    image_references(HOSTILE_MARKDOWN[name])
    assert time.perf_counter() - began < 2


def test_deep_nesting_loses_no_text():
    assert normalize(text_for_hash(parse_html("<div>a" * 2_000))).count("a") == 2_000
    assert visible_text("> " * 300 + "deep").endswith("deep")


@pytest.mark.parametrize(
    ("md", "html"),
    [("***a***", "<em><strong>a</strong></em>"), ("*a **b** c*", "<em>a <strong>b</strong> c</em>"), ("[a *b](c) d*", '<a href="c">a *b</a> d*'), ("[![a](b)](c)", '<a href="c"><img src="b" alt="a"></a>'), ("a_b_c", "a_b_c"), ("`a*` *b*", "<code>a*</code> <em>b</em>"), ("~~x~~ ~y~", "<del>x</del> ~y~"), ("a  \nb", "a<br>b"), ("[a](<b c> \"t\")", '<a href="b c">a</a>'), ("[a [b](c)](d)", '[a <a href="c">b</a>](d)')],
)
def test_spans(md, html):
    assert to_html(md) == f"<p>{html}</p>"
