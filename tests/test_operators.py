import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.functions.hashing import md5_mod, uniform
from millrace.operators import dedup as D
from millrace.operators import episodes as E
from millrace.operators import stages as S
from millrace.operators import training as T
from millrace.operators import validation as V
from millrace.operators.components import bipartite_components
from millrace.operators.order import asof_join, range_join, running, with_row_index
from millrace.operators.skew import heavy_keys, salted_join
from millrace.operators.statistics import ks, profile, psi


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_md5_fold(spark):
    for key in ("abc", "é日本", "", "episode_00000001"):
        assert one(spark, md5_mod(F.col("k"), 1000), "k string", key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % 1000
    shares = spark.range(2000).select((uniform(1, "id") < 0.25).cast("int").alias("u")).agg(F.avg("u")).first()[0]
    assert abs(shares - 0.25) < 0.05


def test_text(spark):
    assert one(spark, X.clean(F.col("t")), "t string", "  naïve  日本★ (5)\n") == "naïve 日本 5"
    for n, why in ((9, "length_filter"), (10, None), (4096, None), (4097, "length_filter")):
        assert one(spark, X.reject_reason(F.col("t")), "t string", "x" * n) == why
    assert one(spark, X.reject_reason(F.col("t")), "t string", "Our Privacy Policy applies") == "boilerplate"
    assert one(spark, X.reject_reason(F.col("t")), "t string", None) == "No text field"
    assert one(spark, X.instruction_format(F.col("t")), "t string", "move(3)") == "structured"
    assert one(spark, X.text_quality(F.col("t")), "t string", "one two three") == pytest.approx(0.56)
    assert one(spark, X.sanitize(F.col("t"), 4), "t string", "../<script\x00abcdef") == "abcd"


def test_arrays(spark):
    x = [1.0, 4.0, 2.0, 50.0]
    s = one(spark, A.stats(F.col("a")), "a array<double>", x)
    assert (s["mean"], s["min"], s["max"], s["median"]) == (14.25, 1.0, 50.0, 3.0) and s["std"] == pytest.approx(np.std(x))
    assert one(spark, A.normalize(F.col("a"), "zscore"), "a array<double>", [3.0, 3.0]) == [0.0, 0.0]
    assert one(spark, A.mean(F.col("a")), "a array<double>", []) is None
    for have, trunc, pad, want in (([], "end", "repeat", [0, 0, 0]), ([1], "end", "zero", [1, 0, 0]), ([1, 2], "end", "repeat", [1, 2, 2]), ([1, 2, 3, 4, 5], "start", "zero", [3, 4, 5]), ([1, 2, 3, 4, 5], "end", "zero", [1, 2, 3]), ([1, 2, 3, 4, 5], "middle", "zero", [2, 3, 4])):
        assert one(spark, A.fit_length(F.col("a"), 3, trunc, pad), "a array<int>", have) == want
    assert one(spark, A.attention_mask(F.size("a")), "a array<int>", [7, 7]) == [[1, 0], [1, 1]]
    assert one(spark, A.decimate(F.col("a"), 2), "a array<int>", [0, 1, 2, 3, 4]) == [0, 2, 4]


def test_resampling():
    at, y = A.resampled(np.array([0, 1, 2.0]), np.array([0, 10, 20.0]), 2)
    assert at.tolist() == [0, 0.5, 1, 1.5, 2] and y.tolist() == [0, 5, 10, 15, 20]
    assert A.resampled(np.array([0, 1, 2.0]), np.array([0, 10, 20.0]), 2, "nearest")[1].tolist() == [0, 10, 10, 20, 20]
    x = np.array([0, 1, 2.5, 3, 4.2])
    cubic = lambda t: 2 * t**3 - t + 1
    at, y = A.resampled(x, cubic(x), 5, "cubic")
    assert np.allclose(y, cubic(at))


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    for n, m in ((50, 20), (300, 260), (200, 10)):
        links = [(int(a), int(b)) for a, b in zip(rng.integers(0, n, n), rng.integers(0, m, n))]
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(("r", a))] = find(("e", b))
        groups = {}
        for a, _ in links:
            groups.setdefault(find(("r", a)), set()).add(a)
        want = {a: min(g) for g in groups.values() for a in g if len(g) > 1}
        df = spark.createDataFrame([*links, (None, 1), (1, None), links[0]], "rec bigint, ent bigint")
        got = dict(map(tuple, bipartite_components(df, chunk=10).collect()))
        assert got == want
    assert bipartite_components(spark.createDataFrame([], "rec bigint, ent bigint")).count() == 0


def test_skewed_join(spark):
    big = spark.range(1000).select((F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50)).alias("k"), "id")
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    assert heavy_keys(counts, ["k"], chunk=100).count() == 1
    out = salted_join(big, small, ["k"], counts, F.col("id"), chunk=100)
    assert out.count() == 1000 and out.filter("v = 2 * k").count() == 1000 and out.columns == ["k", "id", "v"]


def test_order(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("x")).repartition(5)
    assert with_row_index(df, ["x"]).filter("row = x").count() == 500
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 0.5), (3, "b", 3.0)], "id int, k string, t double")
    right = spark.createDataFrame([("a", 1.0, 100), ("a", 10.0, 200), ("b", 4.0, 300)], "k string, t double, v int")
    assert {r.id: r.v for r in asof_join(left, right, "t", ["k"], ["v"]).collect()} == {1: 200, 2: None, 3: None}
    ranges = spark.createDataFrame([(1, 0.0, 2.5), (2, 2.0, 30.0)], "rid int, lo double, hi double")
    points = spark.createDataFrame([(0.0,), (2.2,), (29.0,), (31.0,)], "p double")
    assert sorted((r.p, r.rid) for r in range_join(points, ranges, "p", "lo", "hi", 3.0).collect()) == [(0.0, 1), (2.2, 1), (2.2, 2), (29.0, 2)]


def test_running_equals_windows(spark):
    from pyspark.sql import Window

    spread = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string"))
    df = spark.range(3000).select(spread.alias("k"), (F.col("id") * 7919 % 3001).alias("o"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v")).repartition(6)
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "o", "v", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(upto).alias("s"), F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("g"))
    got = running(df, ["k"], ["o"], {"n": ("row_number", None), "s": ("sum", "v"), "l": ("last_known", "v"), "g": ("lag", "v")})
    assert got.select(F.col("n").cast("long"), *"k o v s l g".split()).exceptAll(want.select("n", *"k o v s l g".split())).count() == 0 and got.count() == 3000
    left, right = df.filter("o % 2 = 0").select("k", "o", F.col("o").alias("id")), df.filter("o % 2 = 1").select("k", "o", "v")
    a, b = (asof_join(left, right, "o", ["k"], ["v"], split_hot=s) for s in (True, False))
    assert a.exceptAll(b).count() == 0 and a.count() == left.count()


def test_validators(spark):
    df = spark.createDataFrame([("text", "hello", "text"), ("text", None, "text"), ("video", "x", None)], "data_type string, text string, format string")
    rows = V.completeness(df).collect()
    assert [r.missing_fields for r in rows] == [[], ["text"], ["frames", "format"]] and [r.completeness_score for r in rows] == [1.0, 0.5, 0.0]
    assert V.completeness(df, allow_partial=False).count() == 1 and V.completeness(df, fill={"text": "-"}).filter("is_valid").count() == 2
    limits = spark.createDataFrame([([1.0, 1.0005, 1.1],), ([],), (None,)], "p array<double>").select(F.struct("p").alias("sensor_data")).selectExpr("struct(sensor_data.p as joint_positions) as sensor_data", "'sensor' as data_type")
    assert [r.violations for r in V.physics(limits, position=(-1.0, 1.0), rejecting=False).collect()] == [["position:joint_2"], [], []]
    named = spark.createDataFrame([({"elbow": 3.0, "wrist": 9.0},)], "m map<string, double>").selectExpr("struct(m as joint_velocities) as sensor_data", "'sensor' as data_type")
    assert V.physics(named, velocity={"elbow": 2.0}, rejecting=False).first().violations == ["velocity:elbow"]
    out = V.schema(spark.createDataFrame([(1, "x", 5.0)], "a int, b string, c double"), {"a": "int", "b": "int", "c": ("float", 0.0, 1.0), "d": "str"}).first()
    assert sorted(out.schema_errors) == ["missing:d", "range:c", "type:b"] and not out.schema_valid
    assert V.corruption(spark.createDataFrame([("text", None, "boom")], "data_type string, text string, error string")).first().corruption_flags == ["error_field_present", "text_missing_data"]
    scored = V.anomaly(V.quality(V.corruption(V.completeness(df)))).collect()
    assert scored[0].anomaly_score == 0 and scored[1].anomaly_score == pytest.approx(0.5) and scored[0].quality_scores.text == 0.3


def test_episodes(spark):
    df = spark.createDataFrame([("e1", 2, "c"), ("e1", 0, "a"), ("e1", 1, None), ("e2", 0, "z")], "episode string, t int, s string")
    out = E.detect_episodes(df)
    assert out.filter("is_episode_start").count() == 2
    assert sorted((r.episode_step, r.is_episode_end) for r in E.episode_bounds(out, "episode_id", "step", 2, 2).collect()) == [(0, False), (1, True)]
    t = E.transitions(out.withColumn("act", F.lit(1)), "episode_id", "step", "s", "act", missing="zero").collect()
    assert [(r.state, r.next_state, r.done) for r in sorted(t, key=lambda r: r.step)] == [("a", None, False), (None, "c", True)]
    assert E.transitions(out.withColumn("act", F.lit(1)), "episode_id", "step", "s", "act").count() == 0
    times = spark.createDataFrame([(0.0, 0.5, 2.0), (None, None, None)], "v double, s double, t double")
    r = E.align_times(times, {"video": "v", "sensor": "s", "text": "t"}, 1.0).collect()
    assert not r[0].temporal_consistent and r[0].aligned_times["text"] == 2.0 and r[1].temporal_consistent and r[1].time_reference is None
    dropped = E.dropout(spark.range(400).selectExpr("id", "'x' as text", "1.0 as observations"), {"sensor": ["observations"], "text": ["text"]}, 0.5, key="id")
    assert dropped.filter("text is null and observations is null").count() == 0 and dropped.filter("has_missing_modalities").count() > 100
    seg = spark.createDataFrame([([0.0, 0.5, 10.0, 200.0],)], "b array<double>")
    assert [(x.segment_start, x.segment_end) for x in E.segment(seg, "b").collect()] == [(0.5, 10.0)]


def test_minhash_against_exact_jaccard(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(80)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 60))
        rows.append((3 * i, " ".join(base)))
        base[5] = "zzzz"
        rows += [(3 * i + 1, " ".join(base)), (3 * i + 2, " ".join(rows[-1][1].split()))]
    rows += [(900, None), (901, "abc"), (902, "abc"), (903, "abd")]
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in rows if t and len(t) > 4}
    exact = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.9}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in D.dedup_texts(df, "doc_id", cell=16).collect()}
    assert len(got) == len(rows) and got[900].keep and got[901].keep and not got[902].keep and got[903].keep
    dropped = {b for _, b in exact}
    hit = sum(not got[b].keep for b in dropped)
    assert hit >= 0.95 * len(dropped) and all(got[3 * i].keep for i in range(60))


def test_modes(spark):
    ids, pairs = spark.createDataFrame([(i,) for i in range(5)], "id bigint"), spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    keep = lambda mode: sorted(r.id for r in D.drop_similar(ids, pairs, mode).filter("keep").collect())
    assert keep("any_earlier") == [0, 3, 4] and keep("greedy") == [0, 2, 3, 4] and keep("components") == [0, 3, 4]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[10] = v[3]
    df = spark.createDataFrame([(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)], "id bigint, e array<double>, c int")
    top = D.nearest(df, df.filter("id % 20 = 0"), "id", "e", 5, block=3).toPandas()
    for q, g in top.groupby("query_id"):
        d = np.linalg.norm(v - v[q], axis=1)
        assert g.sort_values("rank").id.tolist() == np.lexsort((np.arange(200), d))[:5].tolist()
    got = {r.id: r.keep for r in D.dedup_embeddings(df, "id", "e", 0.999, cluster="c", cell=7).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {int(b) for a in range(200) for b in range(a + 1, 200) if a % 2 == b % 2 and unit[a] @ unit[b] >= 0.999}
    assert {i for i, k in got.items() if not k} == want
    seq = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, None), (4, None)], "id bigint, s array<double>")
    assert sorted(r.id for r in D.dedup_sequences(seq, "id", "s").filter("keep").collect()) == [1, 3]


def test_stages(spark):
    df = spark.createDataFrame([("text", "A  fine text here!", None), ("text", "short", None), ("sensor", None, [1.0, 2.0, 3.0])], "data_type string, text string, observations array<double>")
    assert S.TextProcessor().transform(df).count() == 2 and S.TextProcessor(strict=True).transform(df).first().text == "A fine text here!"
    assert S.SensorProcessor(["observations"], normalize="minmax", target_rate=None).transform(df).filter("processed").first().observations[2] == pytest.approx(1.0)
    with pytest.raises(RuntimeError, match="decoder"):
        S.VideoProcessor().transform(df)
    bad = S.DataTransformer(lambda r: {"x": 10 // r["id"]}, "x bigint", error_field="err").transform(spark.range(3))
    assert bad.filter("err is not null").count() == 1
    model = S.BatchInference(lambda: lambda x: x * 2, "id", returns="bigint").transform(spark.range(5))
    assert [r.prediction for r in model.collect()] == [0, 2, 4, 6, 8]
    clean = spark.createDataFrame([([1.0, 1.1, 1.2, 0.9, 1.0, 99.0],)], "a array<double>").select(S.density_outliers(F.col("a")).alias("a")).first().a
    assert 99.0 not in clean and len(clean) == 5
    assert 99.0 not in S.IsolationOutliers("a", 0.2).transform(spark.createDataFrame([([1.0, 1.1, 1.2, 0.9, 1.0, 99.0],)], "a array<double>")).first().a
    for how in ("hash", "round_robin"):
        assert S.shard(spark.range(100), 4, how, "id").select("shard_id").distinct().count() == 4
    for s in S.default_stages():
        df = s.transform(df)
    assert df.count() == 2 and "anomaly_score" in df.columns


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else "x") for i in range(10)], "v double, s string")
    p = {r["column"]: r for r in profile(df).collect()}
    assert p["v"]["mean"] == 4.5 and p["v"]["median"] == 4.5 and p["s"]["missing"] == 5 and p["s"]["mean"] is None
    assert ks(df, df, "v").first().ks == 0 and psi(df, df, "v").first().psi == pytest.approx(0)
    assert ks(df, df.withColumn("v", F.col("v") + 100), "v").first().ks == 1.0


def test_training(spark, tmp_path):
    df = spark.range(200).selectExpr("cast(id % 20 as string) as episode_id", "id")
    assert T.train_split(df).groupBy("episode_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    T.write_splits(df, str(tmp_path / "s"))
    assert T.training_dataset(spark, str(tmp_path / "s")).count() == 200
    assert sum(len(b) for b in T.batches(df, 64)) == 200
    assert T.synthetic_texts(spark, 20).filter("text like '%{%'").count() == 0
    a, b = (T.synthetic_trajectories(spark, 2, 5, 3).collect() for _ in range(2))
    assert a == b and len(a[0].observations[0]) == 6
    assert T.randomized_environments(spark, 3).first().physical.friction == T.randomized_environments(spark, 1).first().physical.friction
    bad = T.check_batch(spark.createDataFrame([([1.0, float("nan")],)], "actions array<double>"), ["state"], "actions", 3).first().batch_errors
    assert bad == ["missing:state", "not_finite", "action_dim"]
    assert T.randomize(spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>"), "a", 0.0, 1).first().a == [1.0, 1.0, 2.0]
