"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest

from loomspan.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    con.sql("set timezone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = Counter(tuple(repr(plain(r[c])) for c in columns) for r in df.collect())
    rows = want.fetchall()
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(repr(plain(r[i])) for i in at) for r in rows)


def test_all_queries_have_sql_or_run(spark, sf):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf).columns


def test_flagship_has_rows(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
