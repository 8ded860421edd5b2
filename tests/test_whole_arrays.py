"""Resampling sees all values of a vector, and keeps them at its own times."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("method", ["linear", "nearest", "cubic_vectors"])
def test_resampled(spark, method):
    got = catalog.queries()[f"resample_{method}"](spark, DATA)
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("e"))
    rows = got.join(given, "vec_id").collect()
    assert len(rows) == given.count() and all(len(r["values"]) == 127 and r["values"][::2] == pytest.approx(r.e, abs=2e-6) for r in rows)
