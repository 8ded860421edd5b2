"""Queries over the frame's protocol and actions: whole tables, each result held against SQL."""

from __future__ import annotations

import uuid
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions import records as R
from millrace.operators import stages as S
from millrace.operators import validation as V
from millrace.plans.catalog import query, read
from millrace.session import shared_dir


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(read(spark, sf_dir, name))


def facts(s: SparkSession, **values: Any) -> DataFrame:
    """One row of what was found out."""
    return s.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()}))


def folder(s: SparkSession) -> str:
    """A new folder that the executors share."""
    return f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}"


# --- actions ---


@query("action_take_head_tail", "SELECT (SELECT sum(n_nationkey) FROM nation WHERE n_nationkey < 5) AS taken, (SELECT sum(n_nationkey) FROM nation WHERE n_nationkey < 10) AS head, (SELECT sum(n_nationkey) FROM nation WHERE n_nationkey >= 22) AS tail")
def action_take_head_tail(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "nation").sort("n_nationkey")
    total = lambda rows: sum(r["n_nationkey"] for r in rows)
    return facts(s, taken=total(f.take(5)), head=total(f.head()), tail=total(f.tail(3)))


@query("action_collect_iterate", "SELECT count(*) AS collected, count(*) AS iterated, sum(n_regionkey) AS regions FROM nation")
def action_collect_iterate(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "nation")
    return facts(s, collected=len(f.collect()), iterated=sum(1 for _ in f), regions=sum(r["n_regionkey"] for r in f))


@query("action_shape_columns", "SELECT count(*) AS n, count(*) AS n_len, 5 AS width, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, false AS is_empty, true AS is_true, true AS none_is_empty FROM customer")
def action_shape_columns(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "customer")
    rows, width = f.shape
    return facts(s, n=rows, n_len=len(f), width=width, columns=",".join(f.columns), is_empty=f.empty, is_true=bool(f), none_is_empty=f.filter("false").empty)


@query("action_contains", "SELECT true AS has_row, false AS has_other, count(*) FILTER (n_name = (SELECT min(n_name) FROM nation)) > 0 AS has_value FROM nation")
def action_contains(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "nation")
    first = min(f["n_name"])
    return facts(s, has_row={"n_nationkey": 3} in f, has_other={"n_nationkey": -1} in f, has_value=first in f)


@query("action_getitem", "SELECT (SELECT sum(r_regionkey) FROM region) AS column_sum, (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7) AS eighth, (SELECT max(n_nationkey) FROM nation) AS last_one, 3 AS sliced, 2 AS chosen, (SELECT count(*) FROM region) AS attribute")
def action_getitem(s: SparkSession, d: str) -> DataFrame:
    f, n = frame(s, d, "region"), frame(s, d, "nation").sort("n_nationkey")
    return facts(s, column_sum=sum(f["r_regionkey"]), eighth=n[7]["n_nationkey"], last_one=n[-1]["n_nationkey"], sliced=len(n[2:8:2]), chosen=len(n[["n_name", "n_regionkey"]].columns), attribute=len(f.r_regionkey))


@query("action_equality_copy", "SELECT true AS same, false AS other, count(*) AS copied FROM region")
def action_equality_copy(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "region")
    return facts(s, same=f == f, other=f == frame(s, d, "nation"), copied=f.copy().count())


@query("action_add_or", "SELECT 2 * count(*) AS added, 2 * count(*) AS either FROM customer")
def action_add_or(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "customer")
    return facts(s, added=(f + f).count(), either=(f | f).count())


@query("action_show_explain_stats", "SELECT true AS scan, true AS pushed, true AS pruned, true AS sized")
def action_show_explain_stats(s: SparkSession, d: str) -> DataFrame:
    """What the plan of a filtered projection says: the filter and the two columns reach the scan."""
    f = frame(s, d, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice")
    plan = f.explain()
    return facts(s, scan="Scan parquet" in plan, pushed="GreaterThan(o_totalprice" in plan, pruned="ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan, sized="sizeInBytes" in f.stats())


@query("action_to_dataset", "SELECT c_custkey FROM customer")
def action_to_dataset(s: SparkSession, d: str) -> DataFrame:
    return Frame.from_dataset(frame(s, d, "customer").to_dataset()).select("c_custkey").df


@query("action_validate_columns", "SELECT true AS refused, true AS nothing_refused")
def action_validate_columns(s: SparkSession, d: str) -> DataFrame:
    def refused(*names: str) -> bool:
        try:
            frame(s, d, "region").select(*names)
        except Exception:
            return True
        return False

    return facts(s, refused=refused("no_such_column"), nothing_refused=refused())


# --- caching, partitioning, sampling ---


@query("keep_cache_persist", "SELECT count(*) AS cached, count(*) AS persisted, count(*) AS materialized, sum(o_custkey) AS total FROM orders")
def keep_cache_persist(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "orders")
    kept = [f.cache(), f.select("o_custkey").persist(), f.materialize()]
    out = facts(s, cached=kept[0].count(), persisted=kept[1].count(), materialized=kept[2].count(), total=kept[1].sum("o_custkey"))
    for k in kept:
        k.df.unpersist()
    return out


@query("keep_checkpoint", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def keep_checkpoint(s: SparkSession, d: str) -> DataFrame:
    counted = frame(s, d, "orders").checkpoint().df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return Frame(counted).checkpoint(folder(s)).df


@query("place_repartition", "SELECT count(*) AS n, 7 AS parts, 3 AS fewer FROM lineitem")
def place_repartition(s: SparkSession, d: str) -> DataFrame:
    spread = frame(s, d, "lineitem").repartition(7)
    number = lambda f: f.df.select(F.spark_partition_id().alias("p")).distinct().count()
    return facts(s, n=spread.count(), parts=number(spread), fewer=number(spread.coalesce(3)))


@query("place_by_hash", "SELECT count(DISTINCT o_custkey) AS keys, 1 AS most_parts FROM orders")
def place_by_hash(s: SparkSession, d: str) -> DataFrame:
    """All rows of a key lie in one partition."""
    placed = frame(s, d, "orders").repartition_by_hash("o_custkey", 6).df.select("o_custkey", F.spark_partition_id().alias("p"))
    return placed.groupBy("o_custkey").agg(F.countDistinct("p").alias("n")).agg(F.count("*").alias("keys"), F.max("n").alias("most_parts"))


@query("sample_n", "SELECT 100 AS n, 100 AS ids, true AS repeatable")
def sample_n(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one = f.sample(n=100, seed=5).df
    again = f.sample(n=100, seed=5).df
    return facts(s, n=one.count(), ids=one.distinct().count(), repeatable=one.exceptAll(again).count() == 0)


@query("sample_fraction", "SELECT true AS near, count(*) AS everything, 0 AS nothing FROM orders")
def sample_fraction(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "orders")
    n, k = f.count(), f.sample(fraction=0.3, seed=1).count()
    return facts(s, near=abs(k - 0.3 * n) < 6 * (0.21 * n) ** 0.5, everything=f.sample(fraction=1.0, seed=1).count(), nothing=f.sample(fraction=0.0, seed=1).count())


# --- row functions ---


@query("rows_rejected", "SELECT count(*) FILTER (s_suppkey % 7 <> 0) AS kept, count(*) FILTER (s_suppkey % 7 = 0) AS rejected, true AS raised FROM supplier")
def rows_rejected(s: SparkSession, d: str) -> DataFrame:
    """Failing rows are counted, or fail the action on request."""
    def inverse(r: dict) -> dict:
        return {"k": r["s_suppkey"], "x": 1.0 / (r["s_suppkey"] % 7)}

    made = frame(s, d, "supplier").map(inverse, "k bigint, x double")
    kept, raised = made.count(), False
    try:
        frame(s, d, "supplier").map(inverse, "k bigint, x double", on_error="raise").count()
    except Exception:
        raised = True
    return facts(s, kept=kept, rejected=made.rejected.value, raised=raised)


@query("rows_error_column", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 100 // (s_suppkey % 5) END AS share, s_suppkey % 5 = 0 AS failed FROM supplier")
def rows_error_column(s: SparkSession, d: str) -> DataFrame:
    out = S.process_rows(read(s, d, "supplier"), lambda r: {"s_suppkey": r["s_suppkey"], "share": 100 // (r["s_suppkey"] % 5)}, "s_suppkey bigint, share bigint")
    return out.select("s_suppkey", "share", F.col("processing_error").isNotNull().alias("failed"))


@query("stage_data_transformer", "SELECT n_nationkey AS k, reverse(n_name) AS name FROM nation WHERE n_regionkey > 1")
def stage_data_transformer(s: SparkSession, d: str) -> DataFrame:
    step = S.DataTransformer(lambda r: {"k": r["n_nationkey"], "name": r["n_name"][::-1]}, "k int, name string", filter_func="n_regionkey > 1")
    return step.transform(read(s, d, "nation"))


@query("records_add_metadata", "SELECT c_custkey, 'csv' AS format, 'sensor' AS data_type FROM customer")
def records_add_metadata(s: SparkSession, d: str) -> DataFrame:
    return R.data_type_flags(read(s, d, "customer"), "sensor", "csv").select("c_custkey", "format", "data_type")


@query("stage_task", "SELECT count(*) AS n, 'positive' AS name, 2 AS retries, 'clean' AS tag FROM customer WHERE c_acctbal > 0")
def stage_task(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.pipeline import task

    @task("positive", retries=2, tags=("clean",))
    def positive(df: DataFrame) -> DataFrame:
        return df.filter("c_acctbal > 0")

    return facts(s, n=positive(read(s, d, "customer")).count(), name=positive.task_name, retries=positive.task_retries, tag=positive.task_tags[0])


@query("stage_factory", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def stage_factory(s: SparkSession, d: str) -> DataFrame:
    def of_nation(df: DataFrame, nation: int) -> DataFrame:
        return df.filter(F.col("c_nationkey") == nation)

    return S.stage(of_nation, nation=3)(read(s, d, "customer")).select("c_custkey")


class _Doubled(S.Stage):
    name = "doubled"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("twice", F.col("c_acctbal") * 2)


@query("stage_custom", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def stage_custom(s: SparkSession, d: str) -> DataFrame:
    return _Doubled().process(read(s, d, "customer")).select("c_custkey", "twice")


@query("registry_components", "SELECT count(*) AS n, true AS refused_twice, true AS refused_unknown, true AS listed FROM nation WHERE n_regionkey = 2")
def registry_components(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.pipeline import Registry

    own = Registry()
    own.register("of_region", factory=lambda region: S.stage(lambda df: df.filter(F.col("n_regionkey") == region)))

    def refused(call: Any) -> bool:
        try:
            call()
        except (KeyError, ValueError):
            return True
        return False

    return facts(s, n=own.create("of_region", 2).transform(read(s, d, "nation")).count(), refused_twice=refused(lambda: own.register("of_region", _Doubled)), refused_unknown=refused(lambda: own.create("nothing")), listed=own.names() == ["of_region"])


@query("registry_create", "SELECT doc_id, length(trim(text)) > 0 AND format IS NOT NULL AS is_valid FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 100")
def registry_create(s: SparkSession, d: str) -> DataFrame:
    """A stage and a validator by name and configuration."""
    from millrace.plans.pipeline import create_stage, create_validator

    df = read(s, d, "documents").filter("length(trim(text)) > 100").withColumn("data_type", F.lit("text"))
    df = create_stage("quality_filter", {"predicates": ["text is not null"]}).transform(df)
    return create_validator("completeness").transform(df).select("doc_id", "is_valid")


@query("registry_datasource", "SELECT count(*) AS n, 'sensor' AS data_type FROM region")
def registry_datasource(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.pipeline import create_datasource

    return create_datasource("path", s, f"{d}/region.parquet").groupBy("data_type").agg(F.count("*").alias("n")).select("n", "data_type")


# --- what a record is ---


@query("record_format", "SELECT row_id, coalesce(lower(format), 'sensor') AS f FROM test_groot WHERE lower(data_type) = 'sensor'")
def record_format(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot").filter("lower(data_type) = 'sensor'")
    return df.select("row_id", R.record_format(df).alias("f"))


@query("record_text", "SELECT doc_id, coalesce(nullif(text, ''), source) AS t FROM documents")
def record_text(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "documents").withColumnRenamed("source", "content")
    return df.select("doc_id", R.extract_text(df).alias("t"))


@query("record_sensor_data", "SELECT row_id, sensor_data.joint_positions AS a, [row_id, row_id + 1] AS b FROM test_groot")
def record_sensor_data(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot")
    made = df.select("row_id", R.extract_sensor_data(df).alias("x"))
    loose = df.select("row_id", F.col("row_id").alias("observations"), (F.col("row_id") + 1).alias("actions"))
    loose = loose.select("row_id", R.extract_sensor_data(loose).alias("y"))
    return made.join(loose, "row_id").select("row_id", F.col("x.joint_positions").alias("a"), F.array("y.observations", "y.actions").alias("b"))


@query("record_has_field", "SELECT row_id, episode_id IS NOT NULL AS has_episode, false AS has_other FROM test_groot")
def record_has_field(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot")
    return df.select("row_id", R.has_field(df, "episode_id").alias("has_episode"), R.has_field(df, "nothing").alias("has_other"))


@query("record_schema_inference", "SELECT 'c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string' AS found")
def record_schema_inference(s: SparkSession, d: str) -> DataFrame:
    return facts(s, found=",".join(f"{k}:{v}" for k, v in V.infer_schema(read(s, d, "customer")).items()))
