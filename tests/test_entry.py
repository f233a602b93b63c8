"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from assayer.queries import core_queries, core_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.astimezone(__import__("datetime").UTC).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def test_names():
    assert core_sql().keys() <= core_queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query_equals_sql(spark, con, name):
    df = core_queries()[name](spark, SF)
    rows = df.collect()
    if name not in core_sql():
        return
    cur = con.execute(core_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    key = lambda r: str([str(x) for x in r])
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=key)
    mine = sorted((tuple(plain(x) for x in r) for r in rows), key=key)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "log_pos"]
