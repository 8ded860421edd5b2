"""Queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, canonical, mixture, neardup, oracles, packing, sentences, splits
from millrace.session import cut

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "mock_data").select("id", "text", F.col("metadata.source").alias("source"))


def _all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock(spark, sf_dir).unionByName(canonical.parse_records(_read(spark, sf_dir, "mock_jsonl")))


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.formatting_duplicates(_all_records(spark, sf_dir))


@_query
def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.collapsed_records(_all_records(spark, sf_dir))


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = splits.linked_groups(_read(spark, sf_dir, "test_groot"))
    return groups.filter("first < rec").select(F.col("first").alias("first_id"), F.col("rec").alias("row_id"))


@_query
def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(_read(spark, sf_dir, "test_groot"), _read(spark, sf_dir, "split_targets"))


@_query
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "test_groot")
    return splits.split_report(p3_splits(spark, sf_dir), rows, _read(spark, sf_dir, "split_targets"))


@_query
def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: whether its whole group is in one split; and whether all shares are within a percent of the targets."""
    got = cut(p3_splits(spark, sf_dir), "splits")
    sizes = got.groupBy("split").agg(F.count("*").alias("n")).join(F.broadcast(_read(spark, sf_dir, "split_targets")), "split", "outer")  # three rows
    total = sizes.agg(F.sum("n").alias("whole"))
    off = sizes.join(F.broadcast(total), how="cross").agg(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("whole") - F.col("target_share"))).alias("off"))  # one row each
    whole = got.groupBy("first_id").agg(F.countDistinct("split").alias("k"))
    return got.join(whole, "first_id").join(F.broadcast(off), how="cross").select("row_id", "first_id", (F.col("k") == 1).alias("one_split"), (F.col("off") < 0.01).alias("shares_kept"))


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_read(spark, sf_dir, "mock_data")).record_pairs()


@_query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_read(spark, sf_dir, "mock_data")).groups()


def _mixture(spark: SparkSession, sf_dir: str) -> mixture.Mixture:
    return mixture.Mixture(_read(spark, sf_dir, "mock_data"), _read(spark, sf_dir, "mix_targets"))


@_query
def p5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).draws()


@_query
def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


@_query
def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source of the targets: whether it has records, holds its share within half a percent, and repeats no record too often; no use is drawn twice."""
    mix = _mixture(spark, sf_dir)
    draws = cut(mix.draws(), "draws")
    twice = draws.groupBy("id", "copy").agg(F.count("*").alias("k")).filter("k > 1").count()
    shares = mix.report(draws)
    able = shares.agg(F.sum(F.when(F.col("records") > 0, F.col("target_share"))).alias("able"))
    there = F.col("records") > 0
    want = F.when(there, F.col("target_share") / F.col("able")).otherwise(0.0)
    return shares.join(F.broadcast(able), how="cross").select(  # one row
        "source", there.alias("has_records"), (F.abs(F.col("share") - want) < 0.005).alias("share_kept"), (F.col("most_used") <= F.col("max_repeats")).alias("repeats_kept"), F.lit(twice == 0).alias("drawn_once")
    )


@_query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_read(spark, sf_dir, "documents"))


@_query
def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the ids decoded again, an empty text for an empty and a null one."""
    return bpe.decode_corpus(p6_ids(spark, sf_dir))


@_query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(_read(spark, sf_dir, "documents")))


@_query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p7_containers(spark, sf_dir))


@_query
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: whether its pieces make up its tokens, it is whole unless it is larger than a container, no container is overfull and their number is within a percent of the least possible."""
    tokens = cut(bpe.count_tokens(_read(spark, sf_dir, "documents")), "tokens")
    packed = cut(packing.pack(tokens), "packed")
    about = packing.packing_report(packed).select((F.col("fullest") <= packing.CAPACITY).alias("none_overfull"), (F.col("containers") <= 1 + 1.01 * F.col("least_containers")).alias("tight"))
    own = packed.groupBy("doc_id").agg(F.sum("size").alias("sum"), F.count("*").alias("pieces"))
    joined = tokens.join(own, "doc_id").join(F.broadcast(about), how="cross")  # one row
    n = F.col("n_tokens")
    return joined.select("doc_id", (F.col("sum") == n).alias("all_packed"), (F.col("pieces") == F.greatest(F.ceil(n / packing.CAPACITY), F.lit(1))).alias("split_only_if_larger"), "none_overfull", "tight")


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(_read(spark, sf_dir, "documents"))


@_query
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, letters): how many letters and digits lie in the sentences of each document that has any; no two sentences overlap."""
    parts = sentences.split_sentences(_read(spark, sf_dir, "documents"), with_text=True)
    inside = F.length(F.regexp_replace("sentence", r"[^\p{L}\p{N}]+", ""))
    per = parts.groupBy("doc_id").agg(F.sum(inside).alias("letters"), F.sum(F.col("end_char") - F.col("start_char")).alias("covered"), (F.max("end_char") - F.min("start_char")).alias("reach"))
    return per.select("doc_id", "letters", (F.col("covered") <= F.col("reach")).alias("apart"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
