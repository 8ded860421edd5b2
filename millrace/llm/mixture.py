"""Mixing sources to target weights.

Each source is cut into hashed blocks. How many uses of a source's blocks each output shard gets is drawn from a
multivariate hypergeometric distribution by a tree: a node splits its shards in two and draws how many of the uses
of each source fall to the left half. A node's draw depends on the seed and its place only, so any task can walk
from the root to a leaf by itself and no plan is sent around. The uses of a source are permuted, shards take disjoint runs of
the permuted sequence, and each shard is shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.canonical import canonical_source, composed
from millrace.session import cut

#: Records of a block and characters of a shard, on average.
BLOCK_RECORDS, SHARD_CHARS = 500, 4_000_000
MAX_SOURCES = 10_000
_UINT = (1 << 64) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` picks without replacement are good, for populations of any size.

    numpy's sampler takes less than 10**9. A larger population is thought to lie at uniform places, and the picks are the first ones: how many
    good and bad lie before a place near the last pick is binomial, and what is left open is about the root of the population.
    """
    sure = 0
    while good + bad >= 10**9 and draws > 0:
        p = draws / (good + bad)
        g, b = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        if g + b <= draws:
            sure, draws, good, bad = sure + g, draws - g - b, good - g, bad - b
        else:
            good, bad = g, b
    return sure + (int(rng.hypergeometric(good, bad, draws)) if draws > 0 else 0)


def hypergeometric_left(seed: int, node: int, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` picks without replacement come from each source that has `counts` uses; fixed by seed and node."""
    rng = np.random.default_rng([seed, node])
    out = np.zeros(len(counts), np.int64)
    rest = int(counts.sum())
    for k, c in enumerate(counts):
        c = int(c)
        if draws <= 0:
            break
        rest -= c
        x = hypergeometric(rng, c, rest, draws) if c else 0
        out[k] = x
        draws -= x
    return out


class SplittingTree:
    """Finds the shard of a position in the sequence of a source's uses."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int):
        self.counts, self.shards, self.seed = np.asarray(counts, np.int64), shards, seed
        self.known: dict[int, np.ndarray] = {}

    def left(self, node: int, counts: np.ndarray, shards: int) -> np.ndarray:
        if node not in self.known:
            total = int(counts.sum())
            self.known[node] = hypergeometric_left(self.seed, node, counts, total * (shards // 2) // shards)
        return self.known[node]

    def shard_of(self, source: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Vectorised descent: all positions in one node go on together."""
        out = np.zeros(len(source), np.int64)
        stack = [(1, self.counts, self.shards, 0, np.arange(len(source)), np.asarray(position, np.int64))]
        while stack:
            node, counts, shards, first, at, pos = stack.pop()
            if not len(at):
                continue
            if shards == 1:
                out[at] = first
                continue
            left = self.left(node, counts, shards)
            goes = pos < left[source[at]]
            stack.append((2 * node, left, shards // 2, first, at[goes], pos[goes]))
            stack.append((2 * node + 1, counts - left, shards - shards // 2, first + shards // 2, at[~goes], pos[~goes] - left[source[at[~goes]]]))
        return out

    def quotas(self) -> np.ndarray:
        """(shards, sources): uses of each source in each shard."""
        out, stack = np.zeros((self.shards, len(self.counts)), np.int64), [(1, self.counts, self.shards, 0)]
        while stack:
            node, counts, shards, first = stack.pop()
            if shards == 1:
                out[first] = counts
                continue
            left = self.left(node, counts, shards)
            stack += [(2 * node, left, shards // 2, first), (2 * node + 1, counts - left, shards - shards // 2, first + shards // 2)]
        return out


def permuted(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudo-random permutation of 0..size-1, computed place by place: a Feistel network, repeated until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def rounds(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & _UINT)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    out = rounds(np.asarray(x, np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = rounds(out[outside])
    return out.astype(np.int64)


class Mixture:
    """A mixture of the records of `df` (id, text and a source) to the shares of `targets` (source, target_share, max_repeats).

    Sources are compared by their words and numbers. Sizes are characters of text. The total is the largest at which every
    source that has records reaches its share without using a record more than its max_repeats times, or
    `total_chars` if that is less. A source first gives all its records as often as they fit into its share, then whole hashed
    blocks, then single records of one block, so it ends less than one record below its share. A target without
    records has share 0 in the report; records without a target, with a null or blank source or text, or a null id are not
    used. Rows that repeat an id are records of their own. Targets that are null or not above 0 aren't used; two
    spellings of one source in the targets are added, with the smaller max_repeats. Without any usable target or record
    the mixture is empty. Clashing column names don't matter.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, source: str = "metadata.source", id_col: str = "id", text: str = "text", seed: int = 7,
                 total_chars: float | None = None, block_records: int = BLOCK_RECORDS, shard_chars: int = SHARD_CHARS):
        spark = df.sparkSession
        key = lambda d: composed(d, "s")
        goals = (
            key(targets.select(F.col("source").alias("s"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")))
            .withColumn("name", canonical_source(F.col("s"))).filter("name != ''")
            .groupBy("name").agg(F.min("s").alias("source"), F.sum("share").alias("share"), F.min("most").alias("most")).orderBy("name").limit(MAX_SOURCES + 1).toPandas()
        )
        if len(goals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
        goals["share"] = goals.share.fillna(0.0).clip(lower=0.0)
        goals["most"] = goals.most.fillna(0).clip(lower=0)
        self.goals, self.seed, self.spark = goals, seed, spark

        rows = key(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.col(source).alias("s")))
        rows = rows.filter("id is not null").filter(F.trim(F.regexp_replace("text", r"(?U)\s+", "")) != "").withColumn("name", canonical_source(F.col("s")))
        index = spark.createDataFrame(list(zip(goals.name, range(len(goals)))), "name string, src int")
        rows = rows.join(F.broadcast(index), "name").select("id", "text", "src", F.length("text").cast("long").alias("chars"))  # at most MAX_SOURCES rows sent
        # chars in the key set repeated ids with other texts apart
        self.rows = cut(rows.withColumn("h", F.xxhash64(F.lit(seed), "src", "id", "text")), "rows")
        counted = self.rows.groupBy("src").agg(F.count("*").alias("records"), F.sum("chars").alias("chars")).toPandas()
        goals = goals.assign(src=range(len(goals))).merge(counted, on="src", how="left").fillna({"records": 0, "chars": 0})
        use = (goals.share > 0) & (goals.most > 0) & (goals.chars > 0)
        able = goals[use]
        total = float((able.most * able.chars / able.share).min()) if len(able) else 0.0
        self.total = min(total, total_chars) if total_chars else total
        goals["quota"] = np.where(use, goals.share * self.total, 0.0)
        # only sources that are used can fill the mixture: their quotas keep the proportions of the targets
        goals["full"] = np.where(use, np.minimum(np.floor(goals.quota / goals.chars.clip(lower=1) + 1e-9), goals.most), 0).astype(int)
        goals["rest"] = np.where(goals.full < goals.most, goals.quota - goals.full * goals.chars, 0.0).clip(min=0)
        goals["blocks"] = np.maximum(np.ceil(goals.records / block_records), 1).astype(int)
        self.goals = goals
        self.shards = max(1, int(np.ceil(self.total / shard_chars)))

    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        """Records with their block, and (src, block, before, inside): characters of the blocks before and of the block."""
        g = self.goals
        sizes = self.spark.createDataFrame([(int(a), int(b), int(c), float(d)) for a, b, c, d in zip(g.src, g.blocks, g.full, g.rest)], "src int, nb int, full int, rest double")
        rows = self.rows.join(F.broadcast(sizes), "src")
        rows = rows.withColumn("block", F.pmod(F.shiftright("h", 8), "nb").cast("long"))
        # summed up in stretches of about the root of the number of blocks, so no task orders all blocks of a source
        per = rows.groupBy("src", "block", "nb").agg(F.sum("chars").alias("inside")).withColumn("stretch", F.floor(F.col("block") / F.ceil(F.sqrt("nb"))))
        whole = per.groupBy("src", "stretch").agg(F.sum("inside").alias("sum"))
        whole = whole.withColumn("start", F.sum("sum").over(Window.partitionBy("src").orderBy("stretch")) - F.col("sum")).drop("sum")
        within = F.sum("inside").over(Window.partitionBy("src", "stretch").orderBy("block")) - F.col("inside")
        per = per.withColumn("within", within).join(whole, ["src", "stretch"])
        return rows, per.select("src", "block", "inside", (F.col("start") + F.col("within")).alias("before"))

    def draws(self) -> DataFrame:
        """(shard, position, copy, id, source, chars, text): every use of a record."""
        rows, per = self._blocks()
        per = cut(per, "blocks")
        rows = rows.join(per, ["src", "block"])
        left = F.col("rest") - F.col("before")
        # the one block where the share runs out is filled record by record
        edge = (left > 0) & (left < F.col("inside"))
        within = Window.partitionBy("src", "block").orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, 0)
        partial = rows.filter(edge).withColumn("extra", (F.sum("chars").over(within) <= left).cast("int"))
        whole = rows.filter(~edge).withColumn("extra", (left >= F.col("inside")).cast("int"))
        used = whole.unionByName(partial).withColumn("uses", F.col("full") + F.col("extra")).filter("uses > 0")
        used = used.select("id", "text", "src", "chars", "block", "nb", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
        used = used.withColumn("use", F.col("block") + F.col("nb") * (F.col("copy") - 1))

        # uses of blocks: `full` rounds over all blocks and those of the last, begun round
        last = per.join(F.broadcast(self._plan()), "src").filter("before < rest").groupBy("src").agg((F.max("block") + 1).alias("begun")).toPandas()
        g = self.goals.merge(last, on="src", how="left").fillna({"begun": 0})
        counts = (g.full * g.blocks + g.begun).to_numpy(np.int64)
        shards, seed = self.shards, self.seed

        def shard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            tree = SplittingTree(counts, shards, seed)
            for src, use in batches:
                s, u = src.to_numpy(np.int64), use.to_numpy(np.int64)
                pos = np.zeros(len(s), np.int64)
                for k in np.unique(s):
                    at = s == k
                    pos[at] = permuted(u[at], int(counts[k]), seed * 1_000_003 + int(k))
                yield pd.Series(tree.shard_of(s, pos))

        shard_of = F.pandas_udf(shard, "long")
        used = used.withColumn("shard", shard_of("src", "use"))
        names = self.spark.createDataFrame([(int(a), b) for a, b in zip(self.goals.src, self.goals.source)], "src int, source string")
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "shard", "id", "copy"), "id", "copy", "text")
        return used.join(F.broadcast(names), "src").select("shard", F.row_number().over(order).alias("position"), "copy", "id", "source", "chars", "text")

    def _plan(self) -> DataFrame:
        return self.spark.createDataFrame([(int(a), float(b)) for a, b in zip(self.goals.src, self.goals.rest)], "src int, rest double")

    def report(self, draws: DataFrame | None = None) -> DataFrame:
        """(source, target_share, share, chars, records, uses, most_used, max_repeats): what each source of the targets reached."""
        used = (self.draws() if draws is None else draws).groupBy("source", "id").agg(F.sum("chars").alias("chars"), F.count("*").alias("uses"), F.max("copy").alias("copy"))
        got = used.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("records"), F.sum("uses").alias("uses"), F.max("copy").alias("most_used"))
        g = self.goals
        targets = self.spark.createDataFrame([(a, float(b), int(c)) for a, b, c in zip(g.source, g.share, g.most)], "source string, target_share double, max_repeats int")
        whole = got.agg(F.sum("chars").alias("whole"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return (
            targets.join(got, "source", "left").join(F.broadcast(whole), how="left")
            .select("source", "target_share", F.coalesce(F.col("chars") / F.col("whole"), F.lit(0.0)).alias("share"), zero("chars"), zero("records"), zero("uses"), zero("most_used"), "max_repeats")
        )
