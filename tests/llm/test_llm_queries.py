"""Every query of the subpackage on the smallest data; those with SQL against DuckDB."""

import glob
import os

import pytest

from paperweir.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert len(set(got)) == len(got)
    if name in queries.SQL:
        import duckdb

        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(queries.SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        at = [names.index(x) for x in columns]
        assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_found_columns(spark, data):
    want = {
        "p1_found": [("name_a", "string"), ("name_b", "string")], "p3_found": [("field_name", "string"), ("id_a", "string"), ("id_b", "string")], "p4_found": [("source_id", "string"), ("field_name", "string"), ("block_no", "int")],
        "p5_found": [("source_id", "string"), ("field_name", "string")], "p6_found": [("source_id", "string"), ("field_name", "string")], "p7_found": [("source_id", "string"), ("line_no", "int")],
        "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint")],
    }
    for name, types in want.items():
        assert queries.QUERIES[name](spark, data).dtypes == types
