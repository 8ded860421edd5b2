"""Every registered query of the subpackage runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

from millrace.llm import queries
from millrace.llm.bpe import DEFAULT_VOCABULARY

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(DEFAULT_VOCABULARY)), reason="no test tables or no vocabulary")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, DATA)
    got = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = db.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == want
