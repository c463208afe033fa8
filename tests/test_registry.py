"""Every registered query with SQL gives that SQL's rows, on the smallest tables."""

import glob
import math
import os

import pytest

from quillspan import registry

DATA = "/root/testdata/sf0.001"
SOME = [n for n in registry.SQL if n[:3] in {"p04", "p09", "p21", "j11", "j12", "j14", "a08", "a19", "a32", "e06", "e09", "e11", "w05", "w20", "d02", "d05", "s08", "s10"}]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_every_query_has_a_distinct_name():
    assert len(registry.QUERIES) > 180


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(registry.SQL[name])
    assert sorted(expected.columns) == columns
    pick = [expected.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in pick) for r in expected.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want
