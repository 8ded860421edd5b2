"""Copies of a snapshot that differ: each reading comes from the smallest id that has one, device by device."""

import random

import duckdb

from millrace.operators.spikes import implausible_readings
from millrace.plans import catalog
from test_spikes import SCHEMA, table

NAN = float("nan")


def test_missing_in_the_first_copy(spark):
    rows = [(100 + i, "a", float(i), 1.0 + i % 2, 1, [1.0, 1.0], [4.0, 4.0], [20.0, 20.0]) for i in range(6)]
    rows += [(1, "a", 9.0, NAN, 1, [None, 1.0], [4.0, 4.0], [NAN]), (2, "a", 9.0, 900.0, 1, [5.0, 9.0], [4.0, 4.0], [130.0, 131.0]), (3, "a", 9.0, 1.0, 1, None, None, [])]
    got = sorted(tuple(r) for r in implausible_readings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted((i, m, d) for i in (1, 2, 3) for m, d in (("cpu_percent", -1), ("gpu_memory_used_mb", 0), ("gpu_temperature", 0), ("gpu_temperature", 1)))


def test_unequal_copies_as_the_sql(spark, tmp_path):
    rng, rows = random.Random(8), []
    blank = lambda x: rng.choice([None, NAN]) if rng.random() < 0.4 else x
    for r in table(5, [300, 80]):
        for k in range(rng.randrange(1, 4)):
            a = [None if x is None or rng.random() < 0.1 else [blank(v) for v in x][: rng.randrange(1, 4)] for x in (r[5], r[7])]
            rows.append((r[0] * 10 + k, r[1], r[2], blank(r[3]), r[4], a[0], r[6], a[1]))
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW resource_snapshot AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    want = {tuple(r) for r in con.sql(catalog.oracle_sql()["p1_found"]).fetchall()}
    got = [tuple(r) for r in implausible_readings(df, blocks=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and got
