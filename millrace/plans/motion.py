"""Queries over trajectories, arrays, vectors and near-duplicates of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import dedup as D
from millrace.operators import episodes as E
from millrace.operators import training as T
from millrace.plans.catalog import query, read
from millrace.session import cut


def _events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events")


@query("episode_boundaries", """SELECT event_id, user_id::VARCHAR AS episode_id, step, step = 0 AS is_episode_start FROM (SELECT *, event_id % 40 AS step FROM events)""")
def episode_boundaries(s: SparkSession, d: str) -> DataFrame:
    df = _events(s, d).withColumns({"trajectory_id": F.col("user_id"), "timestep": F.col("event_id") % 40})
    return E.detect_episodes(df).select("event_id", "episode_id", "step", "is_episode_start")


@query("episode_length_filter", """SELECT event_id, k - 1 AS episode_step, k = least(n, 50) AS is_episode_end FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
    count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 60 AND k <= 50""")
def episode_length_filter(s: SparkSession, d: str) -> DataFrame:
    return E.episode_bounds(_events(s, d), "user_id", ["ts", "event_id"], 60, 50).select("event_id", "episode_step", "is_episode_end")


@query("episode_stats", "SELECT count(*) AS episodes, round(avg(n), 6) AS avg_length, min(n) AS min_length, max(n) AS max_length FROM (SELECT max(event_id) - min(event_id) + 1 AS n FROM events GROUP BY user_id)")
def episode_stats(s: SparkSession, d: str) -> DataFrame:
    return E.episode_statistics(_events(s, d), "user_id", "event_id").withColumn("avg_length", F.round("avg_length", 6))


@query("rl_transitions", """SELECT * FROM (SELECT user_id AS episode_id, event_id AS step, value AS state, event_type AS action, value AS reward, lead(value) OVER w AS next_state, lead(1, 2) OVER w IS NULL AS done
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE next_state IS NOT NULL""")
def rl_transitions(s: SparkSession, d: str) -> DataFrame:
    return E.transitions(_events(s, d), "user_id", "event_id", "value", "event_type", "value")


@query("transition_validate", """SELECT step, len(state) = len(next_state) AS transition_valid FROM (SELECT id AS step, values AS state, lead(values) OVER (PARTITION BY metadata.source ORDER BY id) AS next_state FROM mock_data)
    WHERE state IS NOT NULL AND next_state IS NOT NULL""")
def transition_validate(s: SparkSession, d: str) -> DataFrame:
    """States are whole arrays of naturally varying length."""
    df = read(s, d, "mock_data").select("id", F.col("metadata.source").alias("source"), F.col("values").alias("state"), F.lit(1).alias("a"))
    return E.validate_transitions(E.transitions(df, "source", "id", "state", "a")).select("step", "transition_valid")


@query("temporal_align", """SELECT event_id, ref AS time_reference, gap <= 1.0 AS temporal_consistent FROM (SELECT event_id, coalesce(a, b) AS ref, CASE WHEN a IS NULL THEN 0.0 ELSE abs(b - a) END AS gap FROM
    (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id::DOUBLE END AS a, event_id + (event_id % 5) * 0.4 AS b FROM events))""")
def temporal_align(s: SparkSession, d: str) -> DataFrame:
    df = _events(s, d).selectExpr("event_id", "CASE WHEN event_id % 4 <> 0 THEN double(event_id) END AS sim", "double(event_id + (event_id % 5) * 0.4) AS wall")
    return E.align_times(df, {"wall_clock": "wall", "simulation": "sim"}).select("event_id", "time_reference", "temporal_consistent")


@query("resample_timestamps", "SELECT event_id, [i * 0.5 FOR i IN range((event_id % 4)::INT * 2 + 1)] AS resampled_timestamps FROM events")
def resample_timestamps(s: SparkSession, d: str) -> DataFrame:
    df = _events(s, d).selectExpr("event_id", "double(0) AS a", "double(event_id % 4) AS b")
    return E.align_times(df, {"episode": "a", "step": "b"}, rate=2.0).select("event_id", "resampled_timestamps")


_WHOLE = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _resample(method: str, value: str) -> str:
    return f"SELECT vec_id, list_transform(range(127), lambda i: round({value}, 6)) AS values FROM {_WHOLE}"


@query("resample_linear", _resample("linear", "(e[1 + i // 2] + e[1 + (i + 1) // 2]) / 2"))
def resample_linear(s: SparkSession, d: str) -> DataFrame:
    """All 64 values of each vector."""
    return _resampled(s, d, "linear")


@query("resample_nearest", _resample("nearest", "e[1 + ((i + 1) // 2)]"))
def resample_nearest(s: SparkSession, d: str) -> DataFrame:
    return _resampled(s, d, "nearest")


@query("resample_cubic_vectors")
def resample_cubic_vectors(s: SparkSession, d: str) -> DataFrame:
    return _resampled(s, d, "cubic")


@query("resample_cubic", "SELECT s_suppkey, [round(a * (i / 2.0) ** 3 - b * (i / 2.0) ** 2 + 7, 6) FOR i IN range(23)] AS \"values\" FROM (SELECT s_suppkey, s_nationkey / 8.0 AS a, (s_suppkey % 9) / 4.0 AS b FROM supplier)")
def resample_cubic(s: SparkSession, d: str) -> DataFrame:
    """Values of cubic polynomials, which the spline gives back exactly between them."""
    x = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.col("s_nationkey") / 8.0 * i * i * i - (F.col("s_suppkey") % 9) / 4.0 * i * i + 7)
    times = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: i.cast("double"))
    df = read(s, d, "supplier").withColumn("e", x)
    return df.select("s_suppkey", F.transform(A.resample(times, F.col("e"), 2.0, "cubic")["values"], lambda x: F.round(x, 6)).alias("values"))


def _resampled(s: SparkSession, d: str, method: str) -> DataFrame:
    times = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: i.cast("double"))
    return _vectors(s, d).select("vec_id", F.transform(A.resample(times, F.col("e"), 2.0, method)["values"], _round6).alias("values"))


def _round6(x: F.Column) -> F.Column:
    """To six decimals as SQL engines do it: the scaled double is rounded, and a zero keeps the sign of what was rounded."""
    r = F.round(x * 1e6) / 1e6
    return F.when(r == 0, F.signum(x) * 0.0).otherwise(r)


@query("teleop_segments", """SELECT user_id, segment_start, segment_end FROM (SELECT user_id, t AS segment_start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment_end FROM
    (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t FROM events)) WHERE segment_end - segment_start BETWEEN 60 AND 86400""")
def teleop_segments(s: SparkSession, d: str) -> DataFrame:
    b = _events(s, d).groupBy("user_id").agg(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("b"))
    return E.segment(b, "b", 60, 86400).select("user_id", "segment_start", "segment_end")


@query("modality_dropout", "SELECT row_id, sensor_data IS NULL AND format IS NULL AS had_none, true AS keeps_one, true AS sums_up, true AS flagged, true AS nulled FROM test_groot")
def modality_dropout(s: SparkSession, d: str) -> DataFrame:
    """What holds for every row whatever was drawn: one modality stays, dropped and remaining ones make up what was there, dropped ones are null."""
    df = read(s, d, "test_groot").select("row_id", "sensor_data", F.col("format").alias("text"))
    had = F.array_compact(F.array(F.when(F.col("sensor_data").isNotNull(), F.lit("sensor")), F.when(F.col("text").isNotNull(), F.lit("text"))))
    out = E.dropout(df.withColumn("had", had), {"video": ["frames"], "sensor": ["sensor_data"], "text": ["text"]}, 0.4, key="row_id")
    gone, left = F.col("dropped_modalities"), F.col("remaining_modalities")
    return out.select(
        "row_id", (F.size("had") == 0).alias("had_none"), ((F.size(left) > 0) | (F.size("had") == 0)).alias("keeps_one"),
        (F.array_sort(F.concat(gone, left)) == F.array_sort("had")).alias("sums_up"), (F.col("has_missing_modalities") == (F.size(gone) > 0)).alias("flagged"),
        (F.col("sensor_data").isNotNull() == F.array_contains(left, "sensor")).alias("nulled"),
    )


@query("modality_dropout_share", "SELECT true AS near_rate, true AS repeatable FROM (SELECT count(*) FROM test_groot)")
def modality_dropout_share(s: SparkSession, d: str) -> DataFrame:
    run = lambda: _dropped(s, d)
    a = run()
    got = a.agg(F.count("*").alias("n"), F.sum(F.col("has_missing_modalities").cast("int")).alias("k")).first()
    # each of two modalities goes with 0.1, but never both
    spread = 5 * (0.19 * 0.81 * got.n) ** 0.5
    same = a.exceptAll(run()).count() == 0
    return s.createDataFrame([(abs(got.k - 0.19 * got.n) < spread + 0.02 * got.n, same)], "near_rate boolean, repeatable boolean")


def _dropped(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot").select("row_id", "sensor_data", F.col("format").alias("text"))
    out = E.dropout(df, {"video": ["frames"], "sensor": ["sensor_data"], "text": ["text"]}, 0.1, key="row_id")
    return out.select("row_id", "dropped_modalities", "remaining_modalities", "has_missing_modalities")


# --- arrays ---

_E = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _rounded(c) -> F.Column:
    return F.transform(c, lambda x: F.round(x, 5))


@query("array_stats", f"SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, list_min(e) AS min, list_max(e) AS max, round(list_median(e), 6) AS median FROM {_E}")
def array_stats(s: SparkSession, d: str) -> DataFrame:
    out = _vectors(s, d).select("vec_id", A.stats(F.col("e")).alias("s")).select("vec_id", "s.*")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", "max", F.round("median", 6).alias("median"))


@query("array_zscore", f"SELECT vec_id, list_transform(e, lambda x: round((x - list_avg(e)) / (list_stddev_pop(e) + 1e-8), 5)) AS e FROM {_E}")
def array_zscore(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", _rounded(A.normalize(F.col("e"), "zscore")).alias("e"))


@query("array_minmax", f"SELECT vec_id, list_transform(e, lambda x: round((x - list_min(e)) / (list_max(e) - list_min(e) + 1e-8), 5)) AS e FROM {_E}")
def array_minmax(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", _rounded(A.normalize(F.col("e"), "minmax")).alias("e"))


@query("array_l2", f"SELECT vec_id, list_transform(e, lambda x: round(x / (sqrt(list_dot_product(e, e)) + 1e-8), 5)) AS e FROM {_E}")
def array_l2(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", _rounded(A.normalize(F.col("e"), "l2")).alias("e"))


@query("array_outliers", f"SELECT vec_id, list_filter(e, lambda x: abs(x - list_avg(e)) / (list_stddev_pop(e) + 1e-8) < 1.5) AS e FROM {_E}")
def array_outliers(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", A.remove_outliers(F.col("e"), 1.5).alias("e"))


@query("array_decimate", f"SELECT vec_id, list_transform(range(0, 64, 6), lambda i: e[i + 1]) AS e FROM {_E}")
def array_decimate(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("vec_id", A.decimate(F.col("e"), 10).alias("e"))


@query("distribution", f"SELECT vec_id, round(list_avg(e), 6) AS mean FROM {_E}")
def distribution(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.statistics import distribution as op

    return op(_vectors(s, d), ["e"]).select("vec_id", F.round("distribution.e.mean", 6).alias("mean"))


_VALUES = "(SELECT id, values AS e FROM mock_data WHERE values IS NOT NULL)"


def _values(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "mock_data").filter("values is not null").select("id", F.col("values").alias("e"))


@query("seq_pad_truncate", f"SELECT id, CASE WHEN len(e) >= 6 THEN e[len(e) - 5:] ELSE list_concat(e, list_transform(range(6 - len(e)), lambda i: coalesce(e[len(e)], 0.0))) END AS e FROM {_VALUES}")
def seq_pad_truncate(s: SparkSession, d: str) -> DataFrame:
    return _values(s, d).select("id", A.fit_length(F.col("e"), 6, "start", "repeat").alias("e"))


@query("seq_normalize", f"""SELECT id, len(e) AS e_original_length, n AS e_normalized_length, len(e) < n AS e_was_padded, false AS e_was_truncated, list_concat(e, list_transform(range(n - len(e)), lambda i: 0.0)) AS e
    FROM {_VALUES}, (SELECT max(len(e)) AS n FROM {_VALUES})""")
def seq_normalize(s: SparkSession, d: str) -> DataFrame:
    return E.normalize_sequences(_values(s, d), ["e"])


@query("seq_pack_mask", f"SELECT id, CASE WHEN len(e) >= 8 THEN e[:8] ELSE list_concat(e, list_transform(range(8 - len(e)), lambda i: 0.0)) END AS e, list_transform(range(1, 9), lambda i: CASE WHEN i <= len(e) THEN 1 ELSE 0 END) AS e_mask FROM {_VALUES}")
def seq_pack_mask(s: SparkSession, d: str) -> DataFrame:
    return T.pack_sequences(_values(s, d), ["e"], 8)


@query("causal_mask", f"SELECT id, list_transform(range(len(e)), lambda r: list_transform(range(len(e)), lambda c: CASE WHEN c <= r THEN 1 ELSE 0 END)) AS m FROM {_VALUES}")
def causal_mask(s: SparkSession, d: str) -> DataFrame:
    return T.attention_masks(_values(s, d), "e", "causal", "m").select("id", "m")


@query("vector_topk", """SELECT query_id, id, round(distance, 5) AS distance, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0) WHERE rank <= 10""")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "embeddings")
    return D.nearest(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


# --- near-duplicates ---


@query("dedup_exact_text", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def dedup_exact_text(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", "text")
    members, _ = D.copies(docs, "doc_id", "text")
    return members.filter("id = rep").select(F.col("id").alias("doc_id")).unionByName(docs.filter("text is null").select("doc_id"))


@query("dedup_minhash")
def dedup_minhash(s: SparkSession, d: str) -> DataFrame:
    return D.dedup_texts(read(s, d, "documents"), "doc_id")


_NEAR_TEXTS = """WITH RECURSIVE rec AS (SELECT id, text FROM mock_data WHERE text IS NOT NULL), unit AS (SELECT text, min(id) AS u FROM rec GROUP BY text),
    gram AS (SELECT DISTINCT u, text[i:i + 4] AS g FROM unit, unnest(range(1, length(text) - 3)) AS x(i)), size AS (SELECT u, count(*) AS k FROM gram GROUP BY u),
    near AS (SELECT a.u AS a, b.u AS b FROM gram a JOIN gram b ON a.g = b.g AND a.u < b.u JOIN size x ON x.u = a.u JOIN size y ON y.u = b.u GROUP BY 1, 2 HAVING count(*) >= 0.8 * (max(x.k) + max(y.k) - count(*)))"""


@query("dedup_minhash_exact", f"""{_NEAR_TEXTS} SELECT id, id = u AND u NOT IN (SELECT b FROM near) AS keep, (SELECT count(*) FROM near WHERE a = u OR b = u) AS n_links FROM rec JOIN unit USING (text)
    UNION ALL SELECT id, true, 0 FROM mock_data WHERE text IS NULL""")
def dedup_minhash_exact(s: SparkSession, d: str) -> DataFrame:
    """MinHash candidates verified on the texts, against all pairs."""
    return D.dedup_texts(read(s, d, "mock_data"), "id", exact=True).select("id", "keep", "n_links")


@query("dedup_greedy")
def dedup_greedy(s: SparkSession, d: str) -> DataFrame:
    return D.dedup_texts(read(s, d, "documents"), "doc_id", mode="greedy")


@query("dedup_semantic", """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)
    SELECT vec_id AS id, NOT EXISTS (SELECT 1 FROM p WHERE p.b = vec_id) AS keep, (SELECT count(*) FROM p WHERE p.a = vec_id OR p.b = vec_id) AS n_links FROM embeddings""")
def dedup_semantic(s: SparkSession, d: str) -> DataFrame:
    return D.dedup_embeddings(read(s, d, "embeddings"), "vec_id", "embedding", 0.35, cluster="label").select("id", "keep", "n_links")


@query("dedup_semantic_kmeans", """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)
    SELECT vec_id AS id, NOT EXISTS (SELECT 1 FROM p WHERE p.b = vec_id) AS keep, (SELECT count(*) FROM p WHERE p.a = vec_id OR p.b = vec_id) AS n_links FROM embeddings""")
def dedup_semantic_kmeans(s: SparkSession, d: str) -> DataFrame:
    """Across all clusters: no link is lost against all pairs."""
    return D.dedup_embeddings(read(s, d, "embeddings"), "vec_id", "embedding", 0.35, k=8).select("id", "keep", "n_links")


@query("dedup_both")
def dedup_both(s: SparkSession, d: str) -> DataFrame:
    """A row for each document: the text step, then the vector step on what that keeps (null columns for the rest); `keep` needs both."""
    docs = read(s, d, "documents")
    step = lambda df, name: df.select("id", *[F.col(c).alias(f"{name}_{c}") for c in ("keep", "class_id", "n_links")])
    texts = cut(step(D.dedup_texts(docs, "doc_id"), "text"), "texts")
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    kept = texts.filter("text_keep").select("id").join(vectors, "id", "left")
    out = texts.join(step(D.dedup_embeddings(kept, "id", "embedding", 0.35, cluster="label"), "vector"), "id", "left")
    return out.withColumn("keep", F.col("text_keep") & F.col("vector_keep"))


@query("dedup_sequence", "SELECT id, id = min(id) OVER (PARTITION BY j) AS keep FROM (SELECT row_id AS id, sensor_data.joint_positions::VARCHAR AS j FROM test_groot)")
def dedup_sequence(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot").select("row_id", F.col("sensor_data.joint_positions").alias("j"))
    return D.dedup_sequences(df, "row_id", "j").select("id", "keep")


# --- generators ---
