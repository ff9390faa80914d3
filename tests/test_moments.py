from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.functions.moments import read_moment
from paperweir.operators.timestamps import MomentDictionary, located_values, normalise_moments


def ms(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-06-04T12:57:31.173Z", (ms(2026, 6, 4, 12, 57, 31) + 173, None)),
        ("2024-02-02T14:01:42.713306849+00:00", (ms(2024, 2, 2, 14, 1, 42) + 713, None)),
        ("2021-07-06T10:00:00-05:00", (ms(2021, 7, 6, 15), None)),
        ("20240729T081836Z", (ms(2024, 7, 29, 8, 18, 36), None)),
        ("1678583549", (1678583549000, None)),
        ("1764348265400", (1764348265400, None)),
        ("Updated 2025-11-07 at 14:59 UTC+03:00", (ms(2025, 11, 7, 11, 59), None)),
        ("Sunday, October 26, 2025 - 01:45 (CEST)", (ms(2025, 10, 25, 23, 45), None)),
        ("2026-08-15 06:21 EST", (ms(2026, 8, 15, 11, 21), None)),
        ("2023-01-03 19:45 BST", (ms(2023, 1, 3, 18, 45), None)),
        ("22 novembre 2023 à 9h18", (ms(2023, 11, 22, 9, 18), "")),
        ("30 de mayo de 2024 a las 05:35", (ms(2024, 5, 30, 5, 35), "")),
        ("14. August 2025, 18:15 Uhr", (ms(2025, 8, 14, 18, 15), "")),
        ("28. července 2025 16:43", (ms(2025, 7, 28, 16, 43), "")),
        ("22 июля 2024 г., 01:58", (ms(2024, 7, 22, 1, 58), "")),
        ("мая 9 2024", (ms(2024, 5, 9), "")),
        ("April 12th, 2025", (ms(2025, 4, 12), "")),
        ("19/02/2026 4:15 PM", (ms(2026, 2, 19, 16, 15), "")),
        ("May 21, 2026 12:05 am", (ms(2026, 5, 21, 0, 5), "")),
        ("2026-06-11 03:50 America/Los_Angeles", (ms(2026, 6, 11, 3, 50), "America/Los_Angeles")),
    ],
)
def test_forms(raw, want):
    assert read_moment(raw, "dmy") == want


@pytest.mark.parametrize("raw", [None, "", " ", "2024", "May 2023", "2022-06", "Spring 2024", "0000-00-00", "2025-13-45", "31/02/2024", "3 hours ago", "yesterday", "12:40", "n.d.", "Invalid Date", "2025-02-30T10:00Z"])
def test_no_moment(raw):
    assert read_moment(raw, "dmy") is None


def test_order():
    assert read_moment("04/05/2024", "dmy")[0] == ms(2024, 5, 4)
    assert read_moment("04/05/2024", "mdy")[0] == ms(2024, 4, 5)
    assert read_moment("25/05/2024", "mdy") is None


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2100, 1, 1)).map(lambda t: t.replace(microsecond=0)), st.integers(-12, 14))
def test_round_trip(t, hours):
    want = int((t.replace(tzinfo=UTC) - timedelta(hours=hours)).timestamp() * 1000)
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S ", "%a, %d %b %Y %H:%M:%S ", "%d %B %Y, %H:%M:%S "):
        assert read_moment(t.strftime(form) + f"{'+' if hours >= 0 else '-'}{abs(hours):02d}:00", "dmy") == (want, None)


SOURCE = "id string, title string, publishedAt string, origin struct<locator:string,canonicalUrl:string>, raw string"
PAGE = "sourceId string, date string"
SITE = "host string, home_zone string, date_order string"


def found(spark, sources, pages, path=None):
    sites = spark.createDataFrame([("a.test", "Europe/Berlin", "dmy"), ("u.test", "America/New_York", "mdy")], SITE)
    located = located_values(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(pages, PAGE), sites)
    rows = normalise_moments(located, MomentDictionary(spark, path)).collect()
    return {(r.source_id, r.field_name): r.utc_ms for r in rows}


def test_zones_gaps_and_repeats(spark):
    sources = [
        ("s1", None, "2025-03-30 02:30", ("x", "https://www.a.test/1"), "x"),  # skipped: forward by the gap
        ("s2", None, "2025-10-26 02:30", ("x", "https://a.test:80/2"), "x"),  # repeated: the earlier one
        ("s3", None, "03/04/2025", ("x", "https://m.u.test/3"), "x"),
        ("s4", None, "2025-01-01 00:00", ("x", None), "x"),  # no URL: UTC
        ("s5", None, None, ("x", None), "x"),
        ("s6", None, "soon", ("x", "https://elsewhere.test/"), "x"),
        ("s1", None, "2025-03-30 02:30", ("x", "https://www.a.test/1"), "x"),
    ]
    got = found(spark, sources, [("s2", "2025-01-01"), ("s4", ""), (None, "2025-01-01")])
    assert got == {
        ("s1", "publishedAt"): ms(2025, 3, 30, 1, 30), ("s2", "publishedAt"): ms(2025, 10, 26, 0, 30), ("s3", "publishedAt"): ms(2025, 3, 4, 5), ("s4", "publishedAt"): ms(2025, 1, 1),
        ("s6", "publishedAt"): None, ("s2", "date"): ms(2024, 12, 31, 23), ("s4", "date"): None,
    }
    assert datetime(2025, 10, 26, 2, 30, tzinfo=ZoneInfo("Europe/Berlin")).timestamp() * 1000 == got["s2", "publishedAt"]


def test_empty_tables(spark):
    assert found(spark, [], []) == {}


def test_dictionary_is_kept_and_only_added_to(spark, tmp_path):
    path = f"file://{tmp_path}/moments"
    a = [("s1", None, "2025-01-01T00:00Z", ("x", None), "x")]
    assert found(spark, a, [], path) == {("s1", "publishedAt"): ms(2025, 1, 1)}
    b = [*a, ("s2", None, "2025-01-02T00:00Z", ("x", None), "x")]
    assert found(spark, b, [], path)["s2", "publishedAt"] == ms(2025, 1, 2)
    assert spark.read.parquet(path).count() == 2
