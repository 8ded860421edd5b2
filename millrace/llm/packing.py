"""Filling fixed-capacity containers with items: best-fit decreasing over all items at once.

Sizes are whole numbers up to the capacity, so all that best-fit decreasing depends on is how many items each size has: at most
`capacity` numbers, whatever the number of items. The packing is computed on those, in runs of equal placements, with a
segment tree over remaining capacities that finds the tightest open containers in logarithmic time. It is the same
packing as placing items one by one. Items then look their container up by their rank among items of their size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

CAPACITY = 2048
#: Rows in which one task numbers items of one size.
RANK_BLOCK = 100_000


class _Tightest:
    """Segment tree over remaining capacities; finds the smallest one that is at least `size` and has open containers."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.width)

    def set(self, remaining: int, filled: bool) -> None:
        k = remaining + self.width
        self.filled[k] = filled
        while k > 1:
            k //= 2
            self.filled[k] = self.filled[2 * k] or self.filled[2 * k + 1]

    def find(self, size: int) -> int:
        """-1 if nothing that tight is open."""
        k = size + self.width
        if self.filled[k]:
            return size
        while k > 1:
            if k % 2 == 0 and self.filled[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.filled[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(plan, containers) for `counts` items of each size of 1 to `capacity`.

    A plan row (size, first, n, container, each) tells: of the items of that size, the n from rank `first` on go to
    containers from `container` on, `each` to one. Items of equal size are alike; equally tight containers are taken in the order they became so tight.
    """
    tree = _Tightest(capacity)
    open_at: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # (first container, how many)
    plan: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            if not open_at[remaining]:
                tree.set(remaining, True)
            open_at[remaining].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            fit = tree.find(size)
            if fit < 0:
                fit, first = capacity, made
                each = fit // size
                n = -(-left // each)
                made += n
            else:
                each = fit // size  # a container that took one is the tightest for the next, as long as one fits
                first, there = open_at[fit].popleft()
                n = min(there, -(-left // each))
                if n < there:
                    open_at[fit].appendleft((first + n, there - n))
                elif not open_at[fit]:
                    tree.set(fit, False)
            take = min(left, n * each)
            plan.append((size, rank, take, first, each))
            full, rest = divmod(take, each)
            put(fit - each * size, first, full)
            if rest:
                put(fit - rest * size, first + full, 1)
            left -= take
            rank += take
    return np.array(plan, np.int64).reshape(-1, 5), made


def pack(items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size: str = "n_tokens", rank_block: int = RANK_BLOCK) -> DataFrame:
    """(`id_col`, piece, start, size, container): where each piece of each item goes.

    An item is one piece, unless it exceeds the capacity: then it is cut into full pieces, each a container of its own,
    and a rest that is packed like the other items. Items of size 0, null or negative size need no room and get one piece with a null container. No
    container holds more than its capacity. Repeated ids are items of their own. An empty table gives an empty result.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    whole = cut(items.select(F.col(id_col), n.alias("total")), "items")
    full = F.floor(F.col("total") / capacity).cast("long")
    whole = whole.withColumn("full", full).withColumn("rest", F.col("total") - full * capacity)

    # every piece that shares a container, with its size class and a block of bounded size inside the class
    by_size = whole.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n"))
    counts = {int(s): int(k) for s, k in by_size.toPandas().itertuples(index=False)}  # at most `capacity` rows
    plan, made = best_fit_decreasing(counts, capacity)
    blocks = np.ones(capacity + 1, np.int64)
    for s, k in counts.items():
        blocks[s] = -(-k // rank_block)
    blocks_of = spark.createDataFrame([(int(s), int(blocks[s])) for s in counts], "rest long, blocks long")
    h = F.xxhash64(F.lit("rank"), id_col)
    parts = whole.filter("rest > 0").join(F.broadcast(blocks_of), "rest").withColumn("h", h).withColumn("block", F.pmod("h", "blocks"))
    inside = Window.partitionBy("rest", "block").orderBy("h", id_col)
    starts = cut(parts.groupBy("rest", "block").agg(F.count("*").alias("k")), "starts")
    starts = starts.withColumn("before", F.sum("k").over(Window.partitionBy("rest").orderBy("block")) - F.col("k")).drop("k")
    ranked = parts.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["rest", "block"]).withColumn("rank", F.col("before") + F.col("at"))

    key = plan[:, 0] * (1 << 44) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    sent = spark.sparkContext.broadcast((key[order], plan[order]))  # bounded by the capacity squared, in fact a few thousand rows

    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        keys, rows = sent.value
        for rest, rank in batches:
            at = np.searchsorted(keys, rest.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64), side="right") - 1
            hit = rows[at]
            yield pd.Series(hit[:, 3] + (rank.to_numpy(np.int64) - hit[:, 1]) // hit[:, 4])

    shared = ranked.select(
        id_col, F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("size"), F.pandas_udf(container, "long")("rest", "rank").alias("container")
    )
    # full pieces take containers behind the shared ones, numbered by (block, row): no order over all rows is needed
    own = whole.filter("full > 0")
    groups = max(1, -(-own.count() // rank_block))  # follows the items, so that numbers don't depend on the session
    own = own.withColumn("h", h).withColumn("block", F.pmod("h", F.lit(groups)))
    sums = cut(own.groupBy("block").agg(F.sum("full").alias("k")), "full_starts")
    sums = sums.withColumn("before", F.sum("k").over(Window.orderBy("block")) - F.col("k")).drop("k")  # one row a block
    before = F.sum("full").over(Window.partitionBy("block").orderBy("h", id_col).rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("at", F.coalesce(before, F.lit(0))).join(F.broadcast(sums), "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    own = own.select(
        id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"),
        (F.lit(made) + F.col("before") + F.col("at") + F.col("piece")).alias("container"),
    )
    none = whole.filter("total = 0").select(id_col, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    return shared.unionByName(own).unionByName(none)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, items, tokens, fill, least_containers): how full the containers are, and how many any packing needs at least."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
