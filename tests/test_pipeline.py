import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.stages import QualityFilter, TextProcessor
from millrace.plans import execution as X
from millrace.plans import pipeline as P
from millrace.streaming import events as E


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "rows.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "value": 10 * i, "text": f"some longer text number {i}"}) for i in range(10)))
    return str(path)


def test_run_and_write(spark, source, tmp_path):
    out = str(tmp_path / "out")
    p = P.Pipeline(source, out, [QualityFilter(["value >= 50"]), TextProcessor()], spark)
    assert p.run()["rows"] == 5 and spark.read.parquet(out).count() == 5
    assert p.get_stage_names() == ["quality_filter", "text_processor"] and p.get_status()["sources"] == 1
    both = p + P.Pipeline(source, None, [], spark)
    assert len(both.sources) == 2 and both.plan().count() == 10 and both.config.output == out
    with pytest.raises(ValueError):
        P.Pipeline(out, out)
    with pytest.raises(ValueError):
        P.PipelineConfig(batch_size=0)


def test_builder(spark, source, tmp_path):
    @P.task("double", retries=1)
    def double(df):
        return df.withColumn("value", F.col("value") * 2)

    b = P.PipelineBuilder(spark).source("text", source).stage(double).features({"sq": "value * value"}).validate({"id": "int", "value": "int", "text": "str"}, strict=False)
    built = b.output(str(tmp_path / "o")).gpu(0).cpu().streaming().options(compression="gzip").build()
    assert built.get_stage_names()[0] == "double" and built.config.compression == "gzip" and built.run()["rows"] == 10
    assert spark.read.parquet(str(tmp_path / "o")).agg(F.max("feature_sq")).first()[0] == 180**2
    agg = P.PipelineBuilder(spark).source("path", source).aggregate(["data_type"], {"value": ["sum", "mean"]}).build().plan().first()
    assert agg["sum(value)"] == 450 and agg["mean(value)"] == 45
    dup = spark.createDataFrame([(1, "the same long text again"), (2, "the same long text again"), (3, None)], "id bigint, text string")
    assert sorted(r.id for r in P.PipelineBuilder(spark).source("path", dup).dedup("fuzzy", 0.9).build().plan().collect()) == [1, 3]
    for bad in (lambda: P.PipelineBuilder().build(), lambda: P.PipelineBuilder().output(""), lambda: P.PipelineBuilder().batch(0), lambda: P.PipelineBuilder().checkpoint(0), lambda: P.PipelineBuilder().source("odd", "x"), lambda: P.deduplication("odd", 1, "id")):
        with pytest.raises(ValueError):
            bad()


def test_yaml_and_several(spark, source, tmp_path):
    one = tmp_path / "one.yaml"
    one.write_text(f"sources: [{{path: {source}}}]\noutput: {tmp_path}/y\nstages:\n- text_processor\n- type: quality_filter\n  predicates: ['value < 30']\n")
    p = P.load_from_yaml(str(one), spark)
    assert p.run()["rows"] == 3
    p.to_yaml(str(tmp_path / "again.yaml"))
    many = tmp_path / "many.yaml"
    many.write_text(f"defaults: {{compression: gzip}}\npipelines:\n- {{name: a, sources: {source}, output: {tmp_path}/a}}\n- {{name: b, sources: {source}, output: {tmp_path}/b}}\ncombine: {{mode: join, join_keys: [id], output: {tmp_path}/joined}}\n")
    result = P.load_from_yaml(str(many), spark).run()
    assert result["combined"].count() == 10 and "value_x" in result["combined"].columns
    frames = [spark.range(3).toDF("id"), spark.range(2, 5).toDF("id")]
    assert P.combine(frames, "union").count() == 6 and P.combine(frames, "join", ["id"]).count() == 1 and P.combine(frames) == frames
    with pytest.raises(ValueError):
        P.MultiPipelineRunner([], {"mode": "join"})


def test_checkpoints_and_resume(spark, source, tmp_path):
    calls = []

    def first(df):
        calls.append("first")
        return df.filter("id > 0")

    def second(df):
        calls.append("second")
        if calls.count("second") == 1:
            raise RuntimeError("boom")
        return df.filter("id > 1")

    log = X.Lineage(str(tmp_path / "lineage.jsonl"))
    p = P.Pipeline(source, str(tmp_path / "o"), [first, second], spark, checkpoint_interval=1, checkpoint_dir=str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        p.run(lineage=log)
    assert p.run(resume_from="latest", lineage=log)["rows"] == 8 and calls == ["first", "second", "second"]
    assert [json.loads(x)["type"] for x in (tmp_path / "lineage.jsonl").read_text().splitlines()] == ["START", "FAIL", "START", "COMPLETE"]
    keep = X.Checkpoints(spark, str(tmp_path / "k"), keep=2)
    for i in range(4):
        keep.save(spark.range(i), {"next_stage": i})
    assert len(keep.list()) == 2 and keep.load()[0].count() == 3 and keep.info()["next_stage"] == 3


def test_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1"), (folder / "b.txt").write_text("2")
    inc = X.Incremental(spark, str(tmp_path / "state"))
    todo = inc.pending(str(folder))
    assert todo.count() == 2
    inc.commit(todo)
    before = spark.createDataFrame(X.file_snapshot(spark, str(folder)).collect())
    assert inc.pending(str(folder)).count() == 0
    (folder / "a.txt").write_text("changed"), (folder / "b.txt").unlink(), (folder / "c.txt").write_text("new")
    assert inc.pending(str(folder)).count() == 2
    kinds = {r.path.rsplit("/", 1)[1]: r.change for r in X.changes(before, X.file_snapshot(spark, str(folder))).collect()}
    assert kinds == {"a.txt": "modified", "b.txt": "removed", "c.txt": "added"}


def test_retry_and_limits():
    tries, waits = [], []

    @X.retry(2, 1.0, 3.0, jitter=False, sleep=waits.append)
    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert flaky() == "ok" and waits == [1.0, 3.0]
    with pytest.raises(TimeoutError):
        X.time_limit(0.05)(lambda: time.sleep(1))()
    errors = []
    assert X.partial_failure(lambda: 1 / 0, 7, "here", errors) == 7 and "here" in errors[0]


def test_paths():
    assert X.validate_path("/data/x")[0] and not X.validate_path("a/../../b")[0] and not X.validate_path("")[0]
    assert X.sanitize_path("a/./b//c") == "a/b/c"
    for bad in (lambda: X.sanitize_path("../x"), lambda: X.sanitize_path("/x", allow_absolute=False), lambda: X.sanitize_url("javascript:x")):
        with pytest.raises(ValueError):
            bad()
    assert X.validate_config({"input_path": "/ok", "n": -1}) == ["n: negative"]


def test_registry(spark):
    r = P.Registry()
    r.register("x", dict)
    assert r.create("x", a=1) == {"a": 1} and r.names() == ["x"]
    with pytest.raises(ValueError):
        r.register("x", dict)
    with pytest.raises(KeyError):
        r.create("y")
    df = spark.createDataFrame([("text", None, "text")], "data_type string, text string, format string")
    assert P.create_validator("completeness", reject_invalid=True).transform(df).count() == 0
    assert P.create_stage("text_processor", {"min_length": 1}).min_length == 1
    assert X.health(spark)["healthy"]


def test_stream_of_files(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    run = lambda: E.process_new_files(spark, str(tmp_path / "in"), "id bigint", lambda d: d.filter("id > 4"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run() == 5 and run() == 0  # the filter reaches the scan
    spark.range(10, 20).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 10 and spark.read.parquet(str(tmp_path / "out")).count() == 15
