"""Queries whose values must be those of their SQL to the last bit, the sign of zero included."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.plans import catalog


def both(spark, folder, query, table, key):
    """repr of the rows of `query` and of its SQL, by key."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = db.execute(catalog.oracle_sql()[query])
    columns = [c[0] for c in found.description]
    want = {row[columns.index(key)]: repr(row) for row in found.fetchall()}
    got = catalog.queries()[query](spark, str(folder)).select(*columns).collect()
    assert len(got) == len(want)
    return {r[key]: repr(tuple(r)) for r in got}, want


def test_video_pixels(spark, tmp_path):
    pq.write_table(pa.table({"s_suppkey": np.arange(400)}), tmp_path / "supplier.parquet")
    got, want = both(spark, tmp_path, "video_frames", "supplier", "s_suppkey")
    assert got == want


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_resampled_values(spark, tmp_path, method):
    """Small negative values round to a negative zero, values in the middle of two sixth decimals as in the SQL."""
    x = np.random.default_rng(3).normal(size=(50, 64)).astype(np.float32)
    x[:10] *= np.float32(1e-6)
    x[10:20] = np.round(x[10:20] * 128) / 128 + np.float32(2.0**-7)
    x[20, :4] = [-0.0, 0.0, -3e-7, 3e-7]
    x[21, :4] = [2.0, np.inf, 1.0, -np.inf]
    table = pa.table({"vec_id": np.arange(50), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got, want = both(spark, tmp_path, f"resample_{method}", "embeddings", "vec_id")
    assert got == want
