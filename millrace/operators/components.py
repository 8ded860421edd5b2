"""Connected groups by iterative minimum-label propagation over a bipartite record-entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import CHUNK, salted_join
from millrace.session import cut

MAX_ROUNDS = 200


def bipartite_components(links: DataFrame, record: str = "rec", entity: str = "ent", chunk: int = CHUNK) -> DataFrame:
    """(`record`, `first`): for each record that shares an entity with another, the smallest record of its connected group.

    Each round, an entity takes the least label of its records and a record the least label of its entities; labels are
    followed one step further (pointer jump), equal labels are merged into one node, and entities left with one node
    are done and dropped, so the graph shrinks by a constant factor a round. Labels are compared in hashed order, which
    makes the number of rounds independent of how ids are laid out. An entity, a merged node and a label may each hold a large part of
    the rows, so every join on them is salted. Nulls link nothing. Repeated links count once.
    Records whose entities are all their own don't come out. An empty input gives an empty result.
    """
    base = links.select(F.col(record).alias("rec"), F.col(entity).alias("ent")).dropna().distinct()
    # order by hash, ties by the id itself
    ranked = F.struct(F.xxhash64("rec").alias("h"), F.col("rec").alias("r"))
    edges = cut(_linking(base, chunk), "edges")
    rows = edges.count()
    if not rows:
        return edges.select(F.col("rec").alias(record), F.col("rec").alias("first"))
    all_rows, maps = rows, []
    for k in range(MAX_ROUNDS):
        by_entity = edges.groupBy("ent").agg(F.min(ranked).alias("m"), F.count("*").alias("n"))
        step = (
            salted_join(edges, by_entity.select("ent", "m"), ["ent"], by_entity.select("ent", "n"), F.col("rec"), chunk=chunk, rows=rows)
            .groupBy("rec").agg(F.min("m").alias("m"))
            .select("rec", F.col("m.r").alias("to"))
        )
        step = cut(step, f"step{k}")
        step = _follow(step, step, chunk, rows)
        maps.append(step)
        held = edges.groupBy("rec").agg(F.count("*").alias("n"))
        moved = salted_join(edges, step, ["rec"], held, F.col("ent"), chunk=chunk, rows=rows).select(F.col("to").alias("rec"), "ent").distinct()
        edges = cut(_linking(moved, chunk, rows), f"edges{k}")
        rows = edges.count()
        if not rows:
            break
    else:
        raise RuntimeError("label propagation did not settle")
    # from the last, smallest round back to the records
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        labels = _follow(m, labels, chunk, all_rows)
    labels = cut(labels, "labels")
    first = labels.groupBy("to").agg(F.min("rec").alias("first"), F.count("*").alias("n"))
    out = salted_join(labels, first.select("to", "first"), ["to"], first.select("to", "n"), F.col("rec"), chunk=chunk, rows=all_rows)
    return out.select(F.col("rec").alias(record), "first")


def _follow(step: DataFrame, further: DataFrame, chunk: int, rows: int) -> DataFrame:
    """(rec, to) of `step`, of at most `rows` rows, with `to` followed by one step of `further` where that has one."""
    jump = further.select(F.col("rec").alias("to"), F.col("to").alias("next"))
    held = step.groupBy("to").agg(F.count("*").alias("n"))
    return salted_join(step, jump, ["to"], held, F.col("rec"), chunk=chunk, how="left", rows=rows).select("rec", F.coalesce("next", "to").alias("to"))


def _linking(edges: DataFrame, chunk: int, rows: int | None = None) -> DataFrame:
    """Only links to entities that still hold two nodes or more."""
    linking = edges.groupBy("ent").agg(F.count("*").alias("n")).filter("n > 1")
    return salted_join(edges, linking.select("ent"), ["ent"], linking, F.col("rec"), chunk=chunk, rows=rows)
