"""Every query runs on the smallest tables, and those with SQL give its rows."""

import os
import sys

import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in compare.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(compare.norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if sql := entry.oracle_sql().get(name):
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert mine == sorted(tuple(compare.norm(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
