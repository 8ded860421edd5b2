import random

import numpy as np
import pytest

from millrace.llm.mixture import Mixture, SplittingTree, hypergeometric, hypergeometric_left, permuted

SCHEMA = "id bigint, text string, metadata struct<source: string>"
TARGETS = "source string, target_share double, max_repeats int"


def records(spark, rng, n=2000):
    sources = ["big", "Big.", "mid", "small", None, " ", "untargeted"]
    rows = [(i, "x" * rng.randrange(1, 200) + " w", (rng.choices(sources, [50, 10, 25, 3, 3, 2, 7])[0],)) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "text", ("big",)), (9001, None, ("big",)), (9002, "  ", ("big",)), (9003, "text", None)], SCHEMA)


def test_shares_and_repeats(spark):
    df = records(spark, random.Random(3))
    targets = spark.createDataFrame([("BIG", 0.5, 2), ("mid", 0.3, 2), ("small", 0.19, 8), ("absent", 0.01, 3), ("off", 0.0, 1), (None, 0.5, 1)], TARGETS)
    mix = Mixture(df, targets, block_records=40, shard_chars=20_000)
    draws = mix.draws().toPandas()
    assert not draws.duplicated(["id", "copy"]).any() and set(draws.id) <= set(range(2000))
    report = mix.report().toPandas().set_index("source")
    usable = 0.99
    for name, share in (("BIG", 0.5), ("mid", 0.3), ("small", 0.19)):
        assert report.share[name] == pytest.approx(share / usable, abs=0.01)
        assert draws[draws.source == name].groupby("id").size().max() <= report.max_repeats[name]
        # never more than its quota, and less than one record below it
        quota = share * mix.total
        assert quota - 203 <= report.chars[name] <= quota + 1e-6
    assert report.share["absent"] == 0 and report.share.sum() == pytest.approx(1)
    # the tightest source is used up
    assert min((report.max_repeats - report.most_used)[["BIG", "mid", "small"]]) == 0
    per = draws.groupby("shard").chars.sum()
    assert len(per) == mix.shards and per.max() < 2 * per.mean()
    for _, s in draws.groupby("shard"):
        assert sorted(s.position) == list(range(1, len(s) + 1))


def test_smaller_total_and_repeatable(spark):
    df, targets = records(spark, random.Random(4), 500), spark.createDataFrame([("big", 0.6, 1), ("mid", 0.4, 1)], TARGETS)
    a = Mixture(df, targets, total_chars=5000).draws().toPandas()
    b = Mixture(df, targets, total_chars=5000).draws().toPandas()
    assert a.chars.sum() <= 5000 and a.chars.sum() > 4600
    key = lambda d: d.sort_values(["shard", "position"])[["id", "copy"]].values.tolist()
    assert key(a) == key(b)


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    empty = Mixture(spark.createDataFrame([], SCHEMA), targets)
    assert empty.draws().count() == 0 and empty.report().first().share == 0
    assert Mixture(records(spark, random.Random(1), 20), spark.createDataFrame([], TARGETS)).draws().count() == 0


def test_tree_gives_exact_quotas():
    counts = np.array([5, 0, 1000, 37])
    tree = SplittingTree(counts, 13, seed=1)
    quotas = tree.quotas()
    assert quotas.sum(axis=0).tolist() == counts.tolist() and quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 4
    for s, c in enumerate(counts):
        shards = SplittingTree(counts, 13, seed=1).shard_of(np.full(c, s), np.arange(c))
        assert (np.bincount(shards, minlength=13) == quotas[:, s]).all()


def test_permutation():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_draws_beyond_a_thousand_million_uses_stay_random_and_exact():
    got = {tuple(hypergeometric_left(seed, 1, np.array([6 * 10**8, 6 * 10**8]), 6 * 10**8)) for seed in range(3)}
    assert len(got) == 3 and all(sum(g) == 6 * 10**8 for g in got)
    # mean and spread of the true distribution, for populations of several sizes, few, half and nearly all drawn
    for good, bad, draws in ((10**9, 10**9, 10**9), (3 * 10**11, 10**12, 10**6), (10**10, 10**9, 11 * 10**9 - 1000), (10**9, 2 * 10**9, 3 * 10**9), (2 * 10**9, 0, 5), (10**12, 10**12, 0)):
        n = good + bad
        x = np.array([hypergeometric(np.random.default_rng([seed, 5]), good, bad, draws) for seed in range(400)], float)
        mean, spread = draws * good / n, (draws * (good / n) * (bad / n) * (n - draws) / (n - 1)) ** 0.5
        assert (x <= min(good, draws)).all() and (x >= max(0, draws - bad)).all()
        assert abs(x.mean() - mean) <= 4 * spread / 20 + 1e-6 * mean * (spread == 0) + 1e-9
        assert abs(x.std() - spread) <= 0.2 * spread + 1e-9


def test_blocks_follow_the_records(spark):
    rows = spark.range(60_000).selectExpr("id", "concat('text ', id) as text", "named_struct('source', 'a') as metadata")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = Mixture(rows, targets, block_records=2, shard_chars=20_000)
    assert mix.goals.blocks.tolist() == [30_000]
    per = mix._blocks()[1].orderBy("block").toPandas()
    assert (per.before == per.inside.cumsum() - per.inside).all() and len(per) > 25_000
    draws = mix.draws()
    assert draws.count() == 60_000 == draws.select("id").distinct().count()
    sizes = draws.groupBy("shard").agg({"chars": "sum"}).toPandas()
    assert sizes["sum(chars)"].max() < 40_000
