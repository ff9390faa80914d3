"""Every query of the core runs on the smallest data; those with SQL are compared with DuckDB."""

import glob
import importlib
import math
import os
import sys

import pytest

from paperweir.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalogue.SQL:
        assert len(set(got)) == len(got)
        return
    r = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


def test_entry_point_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "paperweir.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) == set(catalogue.SQL)


def test_filters_and_columns_reach_the_scan(spark, data):
    import io
    from contextlib import redirect_stdout

    from paperweir.sources.readers import find_record

    out = io.StringIO()
    with redirect_stdout(out):
        find_record(spark.read.parquet(f"{data}/articles.parquet"), "art_x").select("id", "title").explain("formatted")
    assert "EqualTo(id,art_x)" in out.getvalue()
    assert "ReadSchema: struct<id:string,title:string>" in out.getvalue()
