"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import bipartite_components
from millrace.operators.skew import CHUNK, salted_join
from millrace.session import cut

#: Words that only say "not known". A value without a letter or digit is a sign for the same.
PLACEHOLDERS = (
    "unknown", "n/a", "na", "n.a.", "none", "null", "nan", "nil", "tbd", "tba", "tbc", "undefined", "unspecified", "missing",
    "not known", "not available", "not applicable", "not set", "not specified", "to be determined", "no value", "unset",
)
KEYS = ("episode_id", "robot_id", "task_id")
#: Groups that are placed one by one, largest first; all others are placed by hashed bins.
LARGE = 2_000
BINS = 4_096
MAX_LABELS = 64


def clean_id(value: Column) -> Column:
    """The id without case and outer blanks; null for null, blank and placeholder values."""
    v = F.lower(F.regexp_replace(F.upper(value.cast("string")), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))
    known = v.rlike(r"[\p{L}\p{N}]") & ~v.isin(*PLACEHOLDERS)
    return F.when(known, v)


def record_entities(df: DataFrame, keys: Sequence[str] = KEYS, meta: str | None = "groot_metadata", id_col: str = "row_id") -> DataFrame:
    """(rec, and one cleaned id a key): the top-level value, or that of `meta` where the top level only says nothing."""
    got = [F.col(id_col).cast("long").alias("rec")]
    for k in keys:
        nested = [clean_id(F.col(f"{meta}.{k}"))] if meta else []
        got.append(F.coalesce(clean_id(F.col(k)), *nested).alias(k))
    return df.select(*got).filter("rec is not null")


def linked_groups(df: DataFrame, keys: Sequence[str] = KEYS, meta: str | None = "groot_metadata", id_col: str = "row_id", chunk: int = CHUNK) -> DataFrame:
    """(rec, first) for every record: the smallest record of its group of directly or indirectly linked records.

    Records are linked by equal ids of the same key, compared without case and outer blanks. Null, blank and placeholder
    ids link nothing. A record that is linked to no other is a group of its own. Repeated rows with the same id are one
    record. An empty table gives an empty result.
    """
    ids = cut(record_entities(df, keys, meta, id_col), "ids")
    # records with the same ids are one node of the graph
    nodes = cut(ids.groupBy(*keys).agg(F.min("rec").alias("node"), F.count("*").alias("n")), "nodes")
    entity = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k))) for i, k in enumerate(keys)])))
    groups = cut(bipartite_components(nodes.select("node", entity.alias("entity")), "node", "entity", chunk=chunk), "groups")
    known = nodes.join(groups, "node", "left").select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], F.coalesce("first", "node").alias("first"), "n")
    # a record without any known id is linked to nothing
    blank = " and ".join(f"{k} = ''" for k in keys)
    recs = ids.select("rec", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys])
    linked = salted_join(recs.filter(f"not ({blank})"), known.filter(f"not ({blank})").drop("n"), list(keys), known.filter(f"not ({blank})").drop("first"), F.col("rec"), chunk=chunk)
    return linked.select("rec", "first").unionByName(recs.filter(blank).select("rec", F.col("rec").alias("first"))).distinct()


def place(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split of each unit; `sizes` has a row a unit and a column a label, `shares` sums to 1.

    Units go largest first, each to the split where it brings the label distribution over splits nearest to the shares.
    """
    want = shares[:, None] * sizes.sum(axis=0)[None, :]
    weight = 1.0 / np.maximum(sizes.sum(axis=0), 1.0)
    have = np.zeros_like(want)
    total_want, total_have = want.sum(axis=1), np.zeros(len(shares))
    scale = 1.0 / max(sizes.sum(), 1.0)
    out = np.zeros(len(sizes), int)
    for u in np.argsort(-sizes.sum(axis=1), kind="stable"):
        x = sizes[u]
        # change of the squared deviations, by label and in total, relative to the share of each split
        by_label = ((2 * (have - want) * x + x * x) * weight**2).sum(axis=1) / shares
        t = x.sum()
        in_total = (2 * (total_have - total_want) * t + t * t) * scale**2 / shares
        k = int(np.argmin(by_label + len(weight) * in_total))
        out[u] = k
        have[k] += x
        total_have[k] += t
    return out


def assign_splits(
    df: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS, meta: str | None = "groot_metadata", id_col: str = "row_id",
    label: str = "data_type", large: int = LARGE, bins: int = BINS, max_labels: int = MAX_LABELS, chunk: int = CHUNK,
) -> DataFrame:
    """(`id_col`, first_id, split): one split of `targets` (split, target_share) for every record.

    Linked records get the same split. The `large` largest groups are placed one by one, all others by `bins` hashed bins
    of groups, so what is placed on the driver has a fixed bound whatever the data. Each is put where
    it brings the distribution of `label` (its `max_labels` most frequent values, the rest as one) over the splits
    nearest to the target shares. Shares are scaled to sum 1; null or negative ones count as 0. A null label is a label.
    Without any target share above 0 this raises ValueError.
    """
    spark = df.sparkSession
    rows = targets.select("split", "target_share").filter("target_share > 0").orderBy("split").limit(1001).collect()
    if not rows or len(rows) > 1000:
        raise ValueError("between 1 and 1000 splits with a target share above 0 are needed")
    names = [r[0] for r in rows]
    shares = np.array([r[1] for r in rows], float)
    shares /= shares.sum()

    groups = cut(linked_groups(df, keys, meta, id_col, chunk), "linked")
    labels = df.select(F.col(id_col).cast("long").alias("rec"), F.lower(F.coalesce(F.col(label).cast("string"), F.lit("(null)"))).alias("label"))
    common = [r[0] for r in labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels - 1).collect()]
    labels = labels.dropDuplicates(["rec"]).withColumn("label", F.when(F.col("label").isin(common), F.col("label")).otherwise("(other)"))
    counted = cut(groups.join(labels, "rec").groupBy("first", "label").agg(F.count("*").alias("n")), "counted")
    size = counted.groupBy("first").agg(F.sum("n").alias("n"))
    biggest = size.orderBy(F.desc("n"), "first").limit(large).select("first", F.lit(True).alias("is_large"))
    unit = F.when(F.col("is_large"), F.concat(F.lit("g"), F.col("first").cast("string"))).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64("first"), F.lit(bins)).cast("string"))
    )
    units = cut(size.join(F.broadcast(biggest), "first", "left").select("first", "n", unit.alias("unit")), "units")
    stats = counted.join(units.drop("n"), "first").groupBy("unit", "label").agg(F.sum("n").alias("n")).toPandas()  # at most (large + bins) x max_labels rows
    table = stats.pivot(index="unit", columns="label", values="n").fillna(0.0).sort_index()
    where = place(table.to_numpy(float), shares) if len(table) else []
    plan = spark.createDataFrame([(u, names[k]) for u, k in zip(table.index, where)], "unit string, split string")
    split = units.join(F.broadcast(plan), "unit").select("first", "split")
    out = salted_join(groups, split, ["first"], units.select("first", "n"), F.col("rec"), chunk=chunk)
    return out.select(F.col("rec").alias(id_col), F.col("first").alias("first_id"), "split")


def split_report(assigned: DataFrame, df: DataFrame, targets: DataFrame, id_col: str = "row_id", label: str = "data_type") -> DataFrame:
    """(split, label, records, share, target_share): the share of each label that each split got."""
    lab = df.select(F.col(id_col), F.coalesce(F.col(label), F.lit("(null)")).alias("label")).dropDuplicates([id_col])
    got = assigned.select(id_col, "split").join(lab, id_col).groupBy("split", "label").agg(F.count("*").alias("records"))
    whole = got.groupBy("label").agg(F.sum("records").alias("whole"))
    return (
        got.join(whole, "label").join(F.broadcast(targets.select("split", "target_share").limit(1000)), "split")
        .select("split", "label", "records", (F.col("records") / F.col("whole")).alias("share"), "target_share")
    )
