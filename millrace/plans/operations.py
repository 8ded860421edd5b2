"""Queries over pipelines and what runs them: builders, YAML, checkpoints, retries, metrics, lineage."""

from __future__ import annotations

import json
import os
import time
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import execution as X
from millrace.plans import tracking as K
from millrace.plans.catalog import query, read
from millrace.plans.pipeline import MultiPipelineRunner, Pipeline, PipelineBuilder, PipelineConfig, infer, load_from_yaml, pipeline, profile, simple, validate
from millrace.plans.surface import facts, folder


def _rich(df: DataFrame) -> DataFrame:
    return df.filter("c_acctbal > 0")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.lower("c_mktsegment"))


def _raises(call: Any, *kinds: type[BaseException]) -> bool:
    try:
        call()
    except kinds or (Exception,):
        return True
    return False


def _place(s: SparkSession) -> str:
    """A folder for small files of the driver."""
    path = folder(s).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


_RICH = "SELECT c_custkey, lower(c_mktsegment) AS label FROM customer WHERE c_acctbal > 0"


@query("pipe_create", _RICH)
def pipe_create(s: SparkSession, d: str) -> DataFrame:
    out = folder(s)
    Pipeline.create(f"{d}/customer.parquet", out, stages=[_rich, _named], spark=s).run()
    return s.read.parquet(out).select("c_custkey", "label")


@query("pipe_helpers", "SELECT count(*) AS n, (SELECT count(*) FROM customer) AS simple_n, (SELECT count(*) FROM customer) AS profile_n, (SELECT count(*) FROM customer) AS validate_n, (SELECT sum(c_custkey * 2) FROM customer)::DOUBLE AS inferred FROM customer WHERE c_acctbal > 0")
def pipe_helpers(s: SparkSession, d: str) -> DataFrame:
    """The short forms: given stages, profiling, a schema check and a model."""
    path, out = f"{d}/customer.parquet", folder(s)
    made = [
        pipeline(path, f"{out}/a", stages=[_rich], spark=s), simple(path, f"{out}/b", [_named], spark=s), profile(path, f"{out}/c", ["c_acctbal"], spark=s),
        validate(path, f"{out}/d", {"c_custkey": "int", "c_acctbal": ("float", -1e9, 1e9)}, strict=False, spark=s), infer(path, f"{out}/e", lambda: lambda x: x * 2.0, "c_custkey", spark=s),
    ]
    n = [p.run()["rows"] for p in made]
    total = s.read.parquet(f"{out}/e").agg(F.sum("prediction")).first()[0]
    return facts(s, n=n[0], simple_n=n[1], profile_n=n[2], validate_n=n[3], inferred=total)


@query("pipe_status", "SELECT 1 AS sources, '_rich,_named,last' AS stages, 'auto' AS mode")
def pipe_status(s: SparkSession, d: str) -> DataFrame:
    p = Pipeline.cpu(f"{d}/customer.parquet", folder(s), stages=[_rich, _named], spark=s).add_stage(lambda df: df, "last")
    about = p.get_status()
    return facts(s, sources=about["sources"], stages=",".join(about["stages"]), mode=about["compute_mode"])


@query("pipe_add", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) + (SELECT count(*) FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3) AS n")
def pipe_add(s: SparkSession, d: str) -> DataFrame:
    """Sources of both, stages of the left one."""
    left = Pipeline(f"{d}/customer.parquet", folder(s), [_rich], s)
    right = Pipeline(read(s, d, "customer").filter("c_nationkey = 3"), None, [], s)
    return facts(s, n=(left + right).run()["rows"])


class _Generator:
    """Anything with generate() is a source."""

    def __init__(self, df: DataFrame):
        self.df = df

    def generate(self) -> DataFrame:
        return self.df


@query("pipe_more_sources", "SELECT n_regionkey, 5 * count(*) AS n FROM nation GROUP BY 1")
def pipe_more_sources(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation")
    p = Pipeline(n, None, [], s)
    p.add_simulation_data(n).add_synthetic_data(n).add_rendered_data(n).add_synthetic_generator(_Generator(n))
    return p.plan().groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("pipe_builder", "SELECT c_nationkey, max(twice) AS \"max(feature_twice)\" FROM (SELECT c_nationkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def pipe_builder(s: SparkSession, d: str) -> DataFrame:
    """Validation, profiling, a row function with a filter, a feature and an aggregation, by the fluent builder."""
    out = folder(s)
    b = PipelineBuilder(s).source("file", f"{d}/customer.parquet").cpu().gpu(0).batch(500).streaming(False)
    b = b.validate({"c_custkey": "int"}, strict=False).profile(["c_acctbal"]).transform(lambda r: {"c_nationkey": r["c_nationkey"], "c_acctbal": r["c_acctbal"]}, schema="c_nationkey int, c_acctbal double", filter_func="c_acctbal > 0")
    b.features({"twice": "c_acctbal * 2"}).aggregate(["c_nationkey"], {"feature_twice": "max"}).output(out).config(compression="zstd").build().run()
    return s.read.parquet(out)


@query("pipe_builder_dedup", "SELECT min(id) AS id FROM mock_data WHERE text IS NOT NULL GROUP BY values::VARCHAR")
def pipe_builder_dedup(s: SparkSession, d: str) -> DataFrame:
    """Equal sequences once; the first by id stays."""
    rows = read(s, d, "mock_data").filter("text is not null").select("id", "values")
    return PipelineBuilder(s).source("file", rows).dedup("sequence", column="values").build().plan().select("id")


@query("pipe_builder_infer_drift", "SELECT sum(event_id * 3)::DOUBLE AS total, 0 AS errors, false AS drift FROM events")
def pipe_builder_infer_drift(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("event_id", "value")
    p = PipelineBuilder(s).source("file", e).infer(lambda: lambda x: x * 3.0, "event_id", output_column="y").drift(e, ["value"]).build()
    got = p.plan().agg(F.sum("y").alias("total"), F.count("inference_error").alias("errors")).first()
    return facts(s, total=got.total, errors=got.errors, drift=p.stages[-1].report(e).first()["drift"])


@query("pipe_builder_refuses", "SELECT true AS no_source, true AS bad_source, true AS bad_batch, true AS bad_interval, true AS no_output")
def pipe_builder_refuses(s: SparkSession, d: str) -> DataFrame:
    b = lambda: PipelineBuilder(s)
    return facts(s, no_source=_raises(b().build), bad_source=_raises(lambda: b().source("nothing", "x")), bad_batch=_raises(lambda: b().batch(0)), bad_interval=_raises(lambda: b().checkpoint(0)), no_output=_raises(lambda: b().output("")))


@query("pipe_config", "SELECT 0.7 AS similarity, 250 AS batch, true AS refused_mode, true AS refused_share, true AS refused_method")
def pipe_config(s: SparkSession, d: str) -> DataFrame:
    c = PipelineConfig.from_dict({"similarity_threshold": 0.7, "batch_size": 250})
    bad = lambda **o: _raises(lambda: PipelineConfig.from_dict(o))
    return facts(s, similarity=c.similarity_threshold, batch=c.batch_size, refused_mode=bad(compute_mode="quantum"), refused_share=bad(similarity_threshold=2.0), refused_method=bad(dedup_method="nothing"))


@query("pipe_yaml", "SELECT doc_id FROM documents WHERE length(text) > 40")
def pipe_yaml(s: SparkSession, d: str) -> DataFrame:
    """A pipeline described in YAML, run, and described again."""
    place, out = _place(s), folder(s)
    with open(f"{place}/a.yaml", "w") as f:
        yaml.safe_dump({"sources": [f"{d}/documents.parquet"], "output": out, "stages": [{"type": "quality_filter", "predicates": ["length(text) > 40"]}, "corruption"]}, f)
    p = load_from_yaml(f"{place}/a.yaml", s)
    p.run()
    p.to_yaml(f"{place}/b.yaml")
    with open(f"{place}/b.yaml") as f:
        said = yaml.safe_load(f)
    if said["output"] != out or len(said["stages"]) != 2:
        raise AssertionError(said)
    return s.read.parquet(out).select("doc_id")


@query("pipe_yaml_several", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def pipe_yaml_several(s: SparkSession, d: str) -> DataFrame:
    """Two pipelines with shared defaults, joined on a key."""
    place, out = _place(s), folder(s)
    spec = {"defaults": {"stages": [{"type": "quality_filter", "predicates": ["c_custkey is not null"]}]}, "combine": {"mode": "join", "join_keys": ["c_custkey"]}, "pipelines": [
        {"name": "a", "sources": [{"path": f"{d}/customer.parquet"}], "output": f"{out}/a", "stages": [{"type": "quality_filter", "predicates": ["c_acctbal > 0"]}]},
        {"name": "b", "sources": [{"path": f"{d}/customer.parquet"}], "output": f"{out}/b"},
    ]}
    with open(f"{place}/a.yaml", "w") as f:
        yaml.safe_dump(spec, f)
    return load_from_yaml(f"{place}/a.yaml", s).run()["combined"].select("c_custkey")


@query("pipe_specs_refused", "SELECT true AS no_output, true AS no_sources, true AS no_join_keys, true AS same_path")
def pipe_specs_refused(s: SparkSession, d: str) -> DataFrame:
    place = _place(s)

    def bad(spec: dict[str, Any]) -> bool:
        with open(f"{place}/a.yaml", "w") as f:
            yaml.safe_dump(spec, f)
        return _raises(lambda: load_from_yaml(f"{place}/a.yaml", s), ValueError)

    return facts(s, no_output=bad({"sources": ["x"]}), no_sources=bad({"output": "x"}), no_join_keys=_raises(lambda: MultiPipelineRunner([], {"mode": "join"}), ValueError), same_path=_raises(lambda: Pipeline("x", "x", spark=s), ValueError))


@query("pipe_default_stages", "SELECT count(*) AS n, count(*) AS scored, count(*) AS checked, count(*) FILTER (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 10) AS dropped FROM documents WHERE false")
def pipe_default_stages(s: SparkSession, d: str) -> DataFrame:
    """The usual chain over an empty table keeps its columns; its work on rows is in pipeline_default_dedup."""
    out = simple(read(s, d, "documents").filter("false"), None, spark=s).plan()
    return out.agg(F.count("*").alias("n"), F.count("quality_score").alias("scored"), F.count("is_corrupted").alias("checked"), F.count("anomaly_score").alias("dropped"))


@query("pipe_checkpoint_resume", _RICH)
def pipe_checkpoint_resume(s: SparkSession, d: str) -> DataFrame:
    """A run that fails in its last stage goes on from the checkpoint, without the first stage."""
    out, keep = folder(s), folder(s)
    calls = []

    def first(df: DataFrame) -> DataFrame:
        calls.append(1)
        return _rich(df)

    def last(df: DataFrame) -> DataFrame:
        if len(calls) == 1 and not calls.append(2):
            raise RuntimeError("broken once")
        return _named(df)

    p = Pipeline(f"{d}/customer.parquet", out, [first, last], s, checkpoint_interval=1, checkpoint_dir=keep)
    if not _raises(p.run, RuntimeError):
        raise AssertionError("the first run should fail")
    p.run(resume_from="latest")
    if calls != [1, 2]:
        raise AssertionError(calls)
    return s.read.parquet(out).select("c_custkey", "label")


@query("checkpoint_store", "SELECT 3 AS listed, 4 AS next_stage, (SELECT count(*) FROM nation WHERE n_regionkey = 4) AS latest, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS by_name, true AS refused")
def checkpoint_store(s: SparkSession, d: str) -> DataFrame:
    """Five saved, three kept; the latest and a named one are read back."""
    keep = X.Checkpoints(s, folder(s), keep=3)
    for k in range(5):
        keep.save(read(s, d, "nation").filter(F.col("n_regionkey") == k), {"next_stage": k}, f"c{k}")
    return facts(s, listed=len(keep.list()), next_stage=keep.info()["next_stage"], latest=keep.load()[0].count(), by_name=keep.load("c2")[0].count(), refused=_raises(lambda: X.Checkpoints(s, folder(s)).info(), FileNotFoundError))


@query("incremental_files", "SELECT 4 AS first, 0 AS again, 2 AS later")
def incremental_files(s: SparkSession, d: str) -> DataFrame:
    """Files are pending until they are committed in their present form: one new and one changed file are found."""
    data, state = folder(s), folder(s)
    n = read(s, d, "nation").coalesce(1)
    for k in range(4):
        n.filter(F.col("n_regionkey") == k).write.csv(f"{data}/r{k}")
    seen = X.Incremental(s, state)
    csv = lambda: seen.pending(data).filter("path like '%.csv'")
    first = csv().count()
    seen.commit(csv())
    again = csv().count()
    n.filter("n_regionkey = 4").write.csv(f"{data}/r4")
    n.filter("n_regionkey < 3").write.mode("overwrite").csv(f"{data}/r0")
    return facts(s, first=first, again=again, later=csv().count())


@query("incremental_hash", "SELECT true AS same, 64 AS length, 1 AS files")
def incremental_hash(s: SparkSession, d: str) -> DataFrame:
    a, b = (X.file_snapshot(s, f"{d}/nation.parquet").collect() for _ in range(2))
    return facts(s, same=a[0]["hash"] == b[0]["hash"], length=len(a[0]["hash"]), files=len(a))


@query("run_retry", "SELECT 3 AS calls, 2 AS told, true AS given_up, true AS other_passes, 2 AS cloud_calls")
def run_retry(s: SparkSession, d: str) -> DataFrame:
    calls, told = [], []

    @X.retry(3, initial_delay=0.0, on_retry=lambda n, e: told.append(n), sleep=lambda t: None)
    def third() -> int:
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return len(calls)

    @X.retry(1, sleep=lambda t: None)
    def never() -> None:
        raise ValueError("no")

    @X.retry(2, exceptions=(OSError,), sleep=lambda t: None)
    def other() -> None:
        raise KeyError("not retried")

    cloud = []

    @X.retry_cloud_storage(2, initial_delay=0.0)
    def store() -> int:
        cloud.append(1)
        if len(cloud) < 2:
            raise ConnectionError("lost")
        return len(cloud)

    return facts(s, calls=third(), told=len(told), given_up=_raises(never, ValueError), other_passes=_raises(other, KeyError), cloud_calls=store())


@query("run_time_limit", "SELECT count(*) AS n, true AS stopped, true AS passes FROM region")
def run_time_limit(s: SparkSession, d: str) -> DataFrame:
    quick = X.time_limit(300, s)(lambda: read(s, d, "region").count())
    slow = X.time_limit(0.2, s)(lambda: time.sleep(3))
    return facts(s, n=quick(), stopped=_raises(slow, TimeoutError), passes=_raises(X.time_limit(60)(lambda: 1 / 0), ZeroDivisionError))


@query("run_partial_failure", "SELECT count(*) AS n, -1 AS fallback, 'reading: ZeroDivisionError: division by zero' AS error FROM region")
def run_partial_failure(s: SparkSession, d: str) -> DataFrame:
    errors: list[str] = []
    return facts(s, n=X.partial_failure(lambda: read(s, d, "region").count()), fallback=X.partial_failure(lambda: 1 / 0, -1, "reading", errors), error=errors[0])


@query("run_lineage", "SELECT 'START,COMPLETE,START,FAIL' AS kinds, count(*) AS rows, true AS told FROM customer WHERE c_acctbal > 0")
def run_lineage(s: SparkSession, d: str) -> DataFrame:
    log = X.Lineage(f"{_place(s)}/lineage.jsonl")
    Pipeline(f"{d}/customer.parquet", folder(s), [_rich], s).run(lineage=log)

    def broken(df: DataFrame) -> DataFrame:
        raise RuntimeError("broken")

    failed = _raises(lambda: Pipeline(f"{d}/customer.parquet", folder(s), [broken], s).run(lineage=log), RuntimeError)
    with open(log.path) as f:
        events = [json.loads(x) for x in f]
    return facts(s, kinds=",".join(e["type"] for e in events), rows=events[1]["rows"], told=failed and events[3]["message"] == "broken")


@query("run_metrics", "SELECT name, kind, value FROM (VALUES ('rows_written', 'total', (SELECT 2.0 * count(*) FROM customer WHERE c_acctbal > 0)), ('runs', 'total', 2.0), ('runs_failed', 'total', 1.0), ('run_seconds', 'count', 2.0)) t(name, kind, value)")
def run_metrics(s: SparkSession, d: str) -> DataFrame:
    m = X.Metrics()
    for stages in ([_rich], [_rich, _named], [lambda df: df.select("nothing")]):
        try:
            Pipeline(f"{d}/customer.parquet", folder(s), stages, s).run(metrics=m)
        except Exception:
            continue
    return s.createDataFrame(m.rows(), "name string, kind string, value double").filter("name != 'run_seconds' or kind = 'count'")


@query("run_stage_profile", "SELECT stage, n AS rows, true AS timed FROM (VALUES ('_rich', (SELECT count(*) FROM customer WHERE c_acctbal > 0)), ('_named', (SELECT count(*) FROM customer WHERE c_acctbal > 0))) t(stage, n)")
def run_stage_profile(s: SparkSession, d: str) -> DataFrame:
    got = Pipeline(f"{d}/customer.parquet", None, [_rich, _named], s).profile()
    return s.createDataFrame([(g["stage"], g["rows"], g["seconds"] > 0) for g in got], "stage string, rows bigint, timed boolean")


@query("run_context", "SELECT 5 AS one, 'x' AS other, true AS gone, true AS known")
def run_context(s: SparkSession, d: str) -> DataFrame:
    c = X.Context(one=1)
    c.set("other", "x")
    c.update(one=5)
    one, other, known = c.get("one"), c.get("other"), "one" in c
    c.clear()
    return facts(s, one=one, other=other, gone=c.get("one") is None, known=known)


@query("run_tuner", "SELECT 134217728 AS scan, 819200 AS partitions, 10000 AS batch, 100 AS wide_batch, 16 AS least")
def run_tuner(s: SparkSession, d: str) -> DataFrame:
    """Settings for 100 TB on 4,000 cores, for rows of a megabyte, and for a small input."""
    big = X.tuned(100 << 40, 4000, 16 << 30, per_core=4, row_bytes=800)
    return facts(
        s, scan=big["spark.sql.files.maxPartitionBytes"], partitions=big["spark.sql.shuffle.partitions"], batch=big["spark.sql.execution.arrow.maxRecordsPerBatch"],
        wide_batch=X.tuned(1 << 30, 8, 8 << 30, row_bytes=1 << 20)["spark.sql.execution.arrow.maxRecordsPerBatch"], least=X.tuned(1 << 20, 8, 8 << 30)["spark.sql.shuffle.partitions"],
    )


@query("run_health", "SELECT true AS healthy, true AS sized")
def run_health(s: SparkSession, d: str) -> DataFrame:
    h = X.health(s)
    return facts(s, healthy=h["healthy"], sized=h["parallelism"] > 0)


@query("run_paths", "SELECT true AS fine, true AS too_long, true AS has_nul, '/a/c' AS clean, true AS traversal, true AS absolute, true AS outside")
def run_paths(s: SparkSession, d: str) -> DataFrame:
    return facts(
        s, fine=X.validate_path("/data/a.parquet")[0], too_long=not X.validate_path("a" * 5000)[0], has_nul=not X.validate_path("a\0b")[0], clean=X.sanitize_path("/a/b/../c"),
        traversal=_raises(lambda: X.sanitize_path("../x"), ValueError), absolute=_raises(lambda: X.sanitize_path("/x", allow_absolute=False), ValueError), outside=_raises(lambda: X.sanitize_path("a/../../x", root="/r"), ValueError),
    )


@query("run_urls_configs", "SELECT 'https://a.example/x' AS url, true AS scheme, 2 AS problems, 0 AS fine")
def run_urls_configs(s: SparkSession, d: str) -> DataFrame:
    return facts(
        s, url=X.sanitize_url(" https://a.example/x "), scheme=_raises(lambda: X.sanitize_url("javascript:alert(1)"), ValueError),
        problems=len(X.validate_config({"output_path": "a\0", "size": -1, "name": "ok"})), fine=len(X.validate_config({"output_path": "/a", "size": 1})),
    )


@query("track_experiment", "SELECT 'start,params,metrics,table,artifact,end' AS kinds, 5 AS rows, true AS failed")
def track_experiment(s: SparkSession, d: str) -> DataFrame:
    events: list[dict[str, Any]] = []
    with K.experiment("e", events.append, {"a": "b"}) as run:
        run.log_params({"x": 1})
        run.log_metrics({"y": 2.0}, step=3)
        run.log_table("region", read(s, d, "region"))
        run.log_artifact("/out")
    kinds = ",".join(e["kind"] for e in events)
    rows = len(events[3]["rows"])

    def broken() -> None:
        with K.experiment("f", events.append):
            raise RuntimeError("broken")

    return facts(s, kinds=kinds, rows=rows, failed=_raises(broken, RuntimeError) and events[-1]["kind"] == "failed")


@query("track_run_pipeline", "SELECT count(*) AS rows, 'start,params,metrics,end' AS kinds FROM customer WHERE c_acctbal > 0")
def track_run_pipeline(s: SparkSession, d: str) -> DataFrame:
    events: list[dict[str, Any]] = []
    result = K.run_pipeline(Pipeline(f"{d}/customer.parquet", folder(s), [_rich], s), "e", events.append)
    return facts(s, rows=result["rows"], kinds=",".join(e["kind"] for e in events))


@query("track_model_registry", "SELECT 2 AS latest, 's3://models/b' AS uri, true AS refused")
def track_model_registry(s: SparkSession, d: str) -> DataFrame:
    """Versions of a model by name, kept as a table."""
    m = K.ModelRegistry(s, folder(s))
    m.register("s3://models/a", "grasp", metadata={"loss": 0.5})
    m.register("s3://models/b", "grasp")
    found = m.get("grasp")
    return facts(s, latest=found["version"], uri=found["uri"], refused=_raises(lambda: m.get("other"), KeyError))


