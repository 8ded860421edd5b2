"""Every registered query of the core runs on the smallest tables and agrees with its SQL."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 5)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got), key=repr) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
