import random

import pytest
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.operators.components import bipartite_components
from millrace.operators.order import has_hot
from millrace.operators.skew import heavy_keys, salted_join


def test_two_thousand_heavy_keys_are_all_salted(spark):
    big = spark.range(2000).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("v"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, ["k"], chunk=3)
    assert heavy.count() == 2000 and heavy.agg(F.min("_salts")).first()[0] == 3
    small = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = sorted(map(tuple, salted_join(big, small, ["k"], counts, F.col("v"), chunk=3).select("k", "v", "w").collect()))
    assert got == [(k, v, 10 * k) for k in range(0, 2000, 2) for v in range(1, 8)]
    kept = salted_join(big, small, ["k"], counts, F.col("v"), chunk=3, how="left")
    assert kept.count() == 14_000 and kept.filter("w is null").count() == 7_000


def find(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, e in links:
        a, b = top(("r", r)), top(("e", e))
        up[max(a, b)] = min(a, b)
    held = {}
    for r, e in links:
        held.setdefault(e, set()).add(r)
    linked = {r for rs in held.values() if len(rs) > 1 for r in rs}
    groups = {}
    for r in {r for r, _ in links}:
        groups.setdefault(top(("r", r)), []).append(r)
    return {r: min(g) for g in groups.values() for r in g if r in linked}


@pytest.mark.parametrize("chunk", [2, 10, 200_000])
def test_groups_with_a_hot_entity_a_hot_node_and_a_long_chain(spark, chunk):
    rng = random.Random(chunk)
    links = [(i, 0) for i in range(0, 300, 2)]  # one entity holds many records
    links += [(5001, e) for e in range(1000, 1080)] + [(6000 + e, e) for e in range(1000, 1080)]  # one record holds many entities
    links += [(10_000 + i, 20_000 + i) for i in range(90)] + [(10_001 + i, 20_000 + i) for i in range(90)]
    links += [(rng.randrange(300, 500), 3000 + rng.randrange(150)) for _ in range(200)]
    links += links[:20]
    rng.shuffle(links)
    df = spark.createDataFrame(links + [(None, 1), (7, None)], "rec bigint, ent bigint").selectExpr("*", "1 as m", "2 as `to`")
    got = {r["rec"]: r["first"] for r in bipartite_components(df, chunk=chunk).collect()}
    assert got == find(links)


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("by", [None, "k"])
def test_fills_of_hot_partitions_equal_those_of_windows(spark, method, by):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), rng.choice([None, None, float(i)])) for i in range(400)]
    f = Frame(spark.createDataFrame(rows, "t bigint, k int, v double").repartition(5))
    plain = f.fill_direction(method, "t", ["v"], by, split_hot=False).df
    spread = f.fill_direction(method, "t", ["v"], by, split_hot=True).df
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


def test_hot_keys_are_found(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "k int")
    assert has_hot(df, ["k"], 8) and not has_hot(df, ["k"], 9) and has_hot(df, [], 9) and not has_hot(df.limit(0), [], 0)
