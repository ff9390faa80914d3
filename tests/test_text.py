import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperweir.functions import text as T
from paperweir.functions.articles import fence, normalize


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("An Example!", "an-example"), ("Élève & Söhne", "eleve-sohne"), ("", "article"), ("日本", "article"), ("a" * 79 + " b", "a" * 79 + "-"), (None, None), ("ﬁn", "fin")],
)
def test_slug(spark, value, want):
    assert one(spark, value, T.slugify) == want


def test_normalise_all_white_space(spark):
    spaces = "\t\n\x0b\f\r         　﻿"
    assert one(spark, f"{spaces}a{spaces}b{spaces}", T.normalize_text) == "a b"
    assert one(spark, "a\u0085b​c᠎", T.normalize_text) == "a\u0085b​c᠎"
    assert one(spark, None, T.normalize_text) is None


def test_plain_text_to_markdown(spark):
    assert one(spark, "a\r\nb\rc <x> & *y* [z](q)!", T.plain_text_to_markdown) == "a\nb\nc &lt;x&gt; &amp; \\*y\\* \\[z\\]\\(q\\)\\!"


@pytest.mark.parametrize(("value", "want"), [("reader@kindle.com", "r*****@kindle.com"), ("fixture-reader@kindle.com", "f********@kindle.com"), ("@x.y", "[redacted]"), ("none", "[redacted]"), ("a@b@c.d", "a***@c.d")])
def test_redact(spark, value, want):
    assert one(spark, value, T.redact_email) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (5 * 1024 * 1024, "5.0 MiB")])
def test_format_bytes(spark, n, want):
    assert spark.createDataFrame([(n,)], "v long").select(T.format_bytes(F.col("v"))).first()[0] == want


def test_record_id(spark):
    assert one(spark, "12345678-1234-1234-1234-123456789abc", lambda c: T.record_id("src", c)) == "src_12345678123412341234123456789abc"
    assert one(spark, "short", lambda c: T.record_id("src", c)) is None


def test_names(spark):
    assert one(spark, 'A: "b"/c?  ..', T.sanitize_filename) == "A- -b--c-"
    assert one(spark, "...", T.sanitize_filename) is None
    assert one(spark, "--", lambda c: T.safe_filename(c, "epub")) == "article.epub"
    assert len(one(spark, "x" * 300, lambda c: T.safe_subject(c, "P"))) == 200


def test_byline_and_unsafe_markdown(spark):
    assert one(spark, "  By Ada X ", T.is_byline) and not one(spark, "Bystander", T.is_byline)
    for bad in ("<script>x", "<a onclick=x>", '<a href="javascript:x">'):
        assert not one(spark, bad, T.is_safe_markdown)
    assert one(spark, "plain <b>text</b>", T.is_safe_markdown)


def test_paths(spark):
    for bad in ("/a", "a//b", "../a", "a/./b", "a\\b", "C:a", ""):
        assert not one(spark, bad, T.is_safe_path)
    assert one(spark, "articles/archive/x/content.md", T.is_safe_path)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_python_normalise_agrees_with_its_definition(x):
    n = normalize(x)
    assert normalize(n) == n
    assert not n.startswith(" ")
    assert not n.endswith(" ")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab`\n", max_size=30))
def test_fence_is_longer_than_any_run(x):
    f = fence(x)
    assert len(f) >= 3
    assert f not in x


def test_spark_slug_equals_python(spark):
    import re

    values = ["Crème brûlée №5", "Ünïcödé ½ ﬁ", "a--b__c", "Ⅷ test"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.slugify(F.col("v")).alias("s")).collect()
    for r in rows:
        x = "".join(c for c in unicodedata.normalize("NFKD", r.v) if not "̀" <= c <= "ͯ").lower()
        assert r.s == (re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", x))[:80] or "article")
