"""Event-time queries over the events, in batch form and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, read
from millrace.session import shared_dir
from millrace.streaming import events as E


def _events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    # a single file is read as a folder of which it is the only match
    return E.stream_files(s, d, schema, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("win_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def win_tumbling(s: SparkSession, d: str) -> DataFrame:
    return _plain(E.windowed(_events(s, d), "ts", "6 hours", keys=["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 4)))


@query("win_sliding", """SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS window_start FROM events, range(2) t(k)) GROUP BY 1""")
def win_sliding(s: SparkSession, d: str) -> DataFrame:
    return _plain(E.windowed(_events(s, d), "ts", "2 hours", "1 hour", n=F.count("*")))


@query("win_session", """SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def win_session(s: SparkSession, d: str) -> DataFrame:
    return _plain(E.sessions(_events(s, d), "ts", "4 hours", ["user_id"], n=F.count("*")))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def stream_tumbling(s: SparkSession, d: str) -> DataFrame:
    out = E.windowed(_stream(s, d), "ts", "1 day", keys=["event_type"], late="365 days", n=F.count("*"))
    return _plain(E.drain(out, f"t{uuid.uuid4().hex}", "complete"))


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    once = E.deduplicated(_stream(s, d), ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type")
    return E.drain(once, f"t{uuid.uuid4().hex}").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_state(s: SparkSession, d: str) -> DataFrame:
    out = E.running_totals(_stream(s, d).select("user_id", "value"), "user_id", "value")
    return E.drain(out, f"t{uuid.uuid4().hex}", "update").groupBy("user_id").agg(F.max_by("n", "n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("stream_new_files", "SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'error'")
def stream_new_files(s: SparkSession, d: str) -> DataFrame:
    base = f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    work = lambda df: df.filter("event_type = 'error'").selectExpr("event_id", "value * 2 AS doubled")
    stream = work(E.stream_files(s, d, schema, pathGlobFilter="events.parquet"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("event_id bigint, doubled double").parquet(f"{base}/out")


@query("pipeline_end_to_end", """SELECT event_type, count(*) AS n, max(feature_double) AS top FROM (SELECT event_type, value * 2 AS feature_double FROM events WHERE value > 10) GROUP BY 1""")
def pipeline_end_to_end(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import QualityFilter
    from millrace.plans.pipeline import PipelineBuilder

    built = PipelineBuilder(s).source("path", read(s, d, "events")).stage(QualityFilter(["value > 10"])).features({"double": "value * 2"}).aggregate(["event_type"], {"event_id": "count", "feature_double": "max"}).build()
    return built.plan().select("event_type", F.col("count(event_id)").alias("n"), F.col("max(feature_double)").alias("top"))


@query("pipeline_dedup_semantic", """SELECT vec_id, label FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.label = b.label AND a.vec_id < b.vec_id
    AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)""")
def pipeline_dedup_semantic(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.pipeline import Pipeline

    built = Pipeline(read(s, d, "embeddings"), spark=s, dedup_method="semantic", similarity_threshold=0.35, dedup_options={"id_col": "vec_id", "cluster": "label"})
    return built.plan().select("vec_id", "label")


@query("pipeline_default_dedup")
def pipeline_default_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents through the default chain, then without near-duplicate texts."""
    from millrace.operators.stages import default_stages
    from millrace.plans.pipeline import Pipeline

    docs = read(s, d, "documents")
    built = Pipeline(docs, stages=default_stages(), spark=s, dedup_method="fuzzy", similarity_threshold=0.8, dedup_options={"id_col": "doc_id"})
    return built.plan().select("doc_id", "text_length", "quality_score", "anomaly_score")


@query("partitioned_output", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def partitioned_output(s: SparkSession, d: str) -> DataFrame:
    from millrace.sources.writers import write_output

    path = f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}/by_lang"
    write_output(read(s, d, "documents"), path, ["lang"])
    return s.read.schema("doc_id bigint, lang string").parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("source_formats", "SELECT n_nationkey, n_name FROM nation")
def source_formats(s: SparkSession, d: str) -> DataFrame:
    """Written and read again as csv, json and TFRecord; all three must agree."""
    from millrace.frame import Frame

    base = f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}"
    nation = Frame(read(s, d, "nation").select("n_nationkey", "n_name"))
    nation.to_csv(f"{base}/n.csv"), nation.to_json(f"{base}/n.json"), nation.to_tfrecords(f"{base}/n.tfrecord")
    csv = Frame.from_paths(s, f"{base}/n.csv").select("n_nationkey", "n_name").df
    js = Frame.from_paths(s, f"{base}/n.json").df.select(F.col("n_nationkey").cast("int"), "n_name")
    tf = Frame.from_paths(s, f"{base}/n.tfrecord").df.select(F.get_json_object("features", "$.n_nationkey[0]").cast("int").alias("n_nationkey"), F.get_json_object("features", "$.n_name[0]").alias("n_name"))
    return csv.intersect(js).intersect(tf)
