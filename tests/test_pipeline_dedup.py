"""dedup_method and similarity_threshold of a pipeline are carried out, whichever way they are given."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.stages import default_stages
from millrace.plans import catalog
from millrace.plans import pipeline as P

LONG = "the same long text again, in several records of the table"
DATA = "/root/testdata/sf0.001"


def rows(spark):
    return spark.createDataFrame([("a", LONG, [1.0, 0.0]), ("b", LONG, [0.0, 1.0]), ("b", "a quite different text about motors", [0.0, 2.0]), (None, None, None)], "id string, text string, embedding array<double>")


def test_methods(spark):
    kept = lambda method, **o: sorted((r.id or "", r.text or "") for r in P.Pipeline(rows(spark), spark=spark, dedup_method=method, **o).plan().collect())
    other = ("b", "a quite different text about motors")
    assert kept(None) == [("", ""), ("a", LONG), other, ("b", LONG)]
    assert kept("fuzzy") == [("", ""), ("a", LONG), other]  # the id is used twice, only one of the two goes
    assert len(kept("semantic")) == 3 and len(kept("both")) == 3
    assert kept("semantic", similarity_threshold=0.0) == [("", ""), ("a", LONG)]
    assert len(kept("fuzzy", dedup_options={"id_col": "none"})) == 3
    for bad in ({"dedup_method": "odd"}, {"dedup_method": "fuzzy", "dedup_options": {"odd": 1}}):
        with pytest.raises(ValueError):
            P.Pipeline(rows(spark), **bad)


def test_yaml_and_dict(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r.asDict()) for r in rows(spark).collect()))
    (tmp_path / "p.yaml").write_text(f"sources: [{{path: {tmp_path}/in.jsonl}}]\noutput: {tmp_path}/out\ndedup_method: fuzzy\nsimilarity_threshold: 0.8\n")
    p = P.load_from_yaml(str(tmp_path / "p.yaml"), spark)
    assert p.get_stage_names() == ["dedup_fuzzy"] and p.run()["rows"] == 3
    p.to_yaml(str(tmp_path / "again.yaml"))
    again = P.load_from_yaml(str(tmp_path / "again.yaml"), spark)
    assert again.get_stage_names() == ["dedup_fuzzy"] and again.config.similarity_threshold == 0.8
    assert P.PipelineBuilder(spark).source("path", rows(spark)).options(dedup_method="fuzzy").build().plan().count() == 3


def test_default_chain(spark):
    names = [s.name for s in default_stages()]
    assert {"detect_episodes", "align_clocks", "text_processor", "completeness", "physics", "cross_modal", "quality"} <= set(names)
    df = spark.createDataFrame([("sensor", 1.0, 5.0), ("sensor", 1.0, 1.5), ("sensor", None, 2.0)], "data_type string, sensor_timestamp double, video_timestamp double")
    for s in default_stages():
        df = s.transform(df)
    assert [r.temporal_consistency_warning for r in df.orderBy(F.desc("video_timestamp")).collect()] == [True, None, None]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_the_chain_without_duplicates(spark):
    got = sorted(r.doc_id for r in catalog.queries()["pipeline_default_dedup"](spark, DATA).collect())
    from millrace.operators.dedup import dedup_texts

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    for s in default_stages():
        df = s.transform(df)
    want = sorted(r.id for r in dedup_texts(df, "doc_id", threshold=0.8).filter("keep").collect())
    assert got == want and len(want) < df.count()
