import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperweir.functions import url as U
from paperweir.functions.web import site_host


@pytest.mark.parametrize(
    ("value", "base", "want"),
    [
        ("/path?utm_source=feed&Ref=partner&keep=yes#:~:text=ignored", "https://example.test/base", "https://example.test/path?keep=yes"),
        ("javascript:alert(1)", "https://example.test/", ""),
        ("#section", "https://example.test/", "#section"),
        ("HTTPS://EXAMPLE.test:443/a/../b", None, "https://example.test/b"),
        ("mailto:a@b.c", None, "mailto:a@b.c"),
        ("", "https://example.test/", ""),
        (None, None, ""),
        ("//other.test/x", "https://example.test/", "https://other.test/x"),
        ("https://e.test/?q=a b&fbclid=1", None, "https://e.test/?q=a+b"),
    ],
)
def test_clean(value, base, want):
    assert U.clean_one(value, base) == want


@settings(max_examples=80, deadline=None)
@given(st.from_regex(r"https://[a-z]{1,8}\.test/[a-z/]{0,10}(\?(utm_[a-z]{1,4}|[a-z]{1,4})=[a-z0-9]{0,4}(&ref=[a-z]{1,3})?)?(#[a-z]{0,5})?", fullmatch=True))
def test_cleaning_is_idempotent(u):
    once = U.clean_one(u, None)
    assert U.clean_one(once, None) == once
    assert "utm_" not in once


def test_native_cleaning_agrees(spark):
    urls = ["https://e.test/a?x=1&utm_source=f&y=2#frag", "https://e.test/a", "https://e.test/?ref=1", "https://e.test/a#:~:text=q"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.strip_tracking(F.col("u")).alias("c")).collect()
    assert all(r.c == U.clean_one(r.u, None) for r in rows)


@pytest.mark.parametrize(
    ("ip", "private"),
    [("127.0.0.1", True), ("10.1.2.3", True), ("8.8.8.8", False), ("172.16.0.1", True), ("172.32.0.1", False), ("198.51.100.7", True), ("198.51.101.7", False), ("::1", True), ("[::1]", True), ("fe80::1", True),
     ("2001:4860::8888", False), ("::ffff:8.8.8.8", False), ("::ffff:10.0.0.1", True), ("example.test", True), ("999.1.1.1", True)],
)
def test_private(spark, ip, private):
    assert spark.createDataFrame([(ip,)], "v string").select(U.is_private_address(F.col("v"))).first()[0] is private


@pytest.mark.parametrize(("u", "ok"), [("https://e.test/a.png", True), ("http://127.0.0.1/a", False), ("https://u:p@e.test/a", False), ("http://localhost/a", False), ("http://x.localhost/", False), ("ftp://e.test/a", False), (None, False)])
def test_public_image_urls(spark, u, ok):
    assert spark.createDataFrame([(u,)], "v string").select(U.is_public_image_url(F.col("v"))).first()[0] is ok


@pytest.mark.parametrize(("u", "host"), [("https://WWW.E.test:8080/a", "e.test"), ("https://amp.e.test", "e.test"), ("https://m.e.test/?x", "e.test"), (None, None), ("no url", None), ("https://mail.e.test", "mail.e.test")])
def test_site_host(spark, u, host):
    assert spark.createDataFrame([(u,)], "v string").select(site_host(F.col("v"))).first()[0] == host


def test_paths_and_stems(spark):
    assert spark.range(1).select(U.encode_path(F.lit("a b/ü(1)!.png"))).first()[0] == "a%20b/%C3%BC(1)!.png"
    assert U.asset_stem_one("https://e.test/img/My%20pic.final.png?x") == "My-pic.final"
    assert U.asset_stem_one("///") == "image"
