import json

import pytest

from millrace.operators.stores import FeatureStore, VectorStore
from millrace.plans.pipeline import Pipeline
from millrace.plans.tracking import experiment, json_lines, run_pipeline


def test_vectors(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), 2)
    store.add(spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [0.1, 0.0], "b"), (3, [5.0, 5.0], "c")], "id bigint, embedding array<double>, text string"))
    assert [r.text for r in store.search([0.0, 0.0]).collect()] == ["a", "b"]
    assert store.search([0.0, 0.0], limit=1).count() == 1 and store.search([0.0, 0.0], max_distance=None).count() == 3
    with pytest.raises(Exception, match="2 numbers"):
        store.add(spark.createDataFrame([(4, [1.0], "d")], "id bigint, embedding array<double>, text string"))


def test_features(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "f"))
    store.register("load", spark.createDataFrame([("r1", 1.0, 10), ("r1", 5.0, 50)], "robot string, t double, load int"), ["robot"], "t", owner="x")
    store.register("kind", spark.createDataFrame([("r1", "arm")], "robot string, kind string"), ["robot"])
    asked = spark.createDataFrame([("r1", 3.0), ("r2", 3.0)], "robot string, at double")
    assert {r.robot: (r.load, r.kind) for r in store.lookup(asked, ["load", "kind"], "at").collect()} == {"r1": (10, "arm"), "r2": (None, None)}
    assert store.describe("load")["owner"] == "x"


def test_tracking(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    result = run_pipeline(Pipeline(spark.range(5), None, [], spark), "try", json_lines(str(log)))
    assert result["rows"] == 5
    with pytest.raises(ZeroDivisionError), experiment("bad", json_lines(str(log))) as run:
        run.log_table("t", spark.range(3))
        1 / 0
    kinds = [json.loads(x)["kind"] for x in log.read_text().splitlines()]
    assert kinds == ["start", "params", "metrics", "end", "start", "table", "failed"]
