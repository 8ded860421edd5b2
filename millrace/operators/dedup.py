"""Deduplication of texts, embeddings and sequences, and vector search.

Exact copies are merged first. Candidates share a bucket (a band of MinHash values, or a given cluster); the pairs of a bucket are
compared inside tasks, in cells of bounded size, and only similar ones come out. Without given clusters, embeddings are compared
across all cells that can hold a similar pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import bipartite_components
from millrace.operators.skew import CHUNK, salted_join
from millrace.session import cut

MODES = ("any_earlier", "greedy", "components")
HASHES, BANDS, GRAM = 100, 20, 5
CELL = 2_000
LEAST = 50


def _coefficients(hashes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, hashes) * 2 + 1).astype(np.uint32)[:, None], rng.integers(0, 1 << 32, hashes).astype(np.uint32)[:, None]


def minhash(text: str | None, hashes: int = HASHES, gram: int = GRAM) -> np.ndarray | None:
    """Least values of `hashes` hash functions (multiply and add in 32 bits) over the distinct character grams; None for texts shorter than the gram."""
    if text is None:
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < gram:
        return None
    m = len(c) - gram + 1
    h = np.zeros(m, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m] + np.uint64(1)
    h ^= h >> np.uint64(31)
    h = np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients(hashes)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (a * h[at : at + 4096] + b).min(axis=1))
    return (least >> np.uint32(1)).astype(np.int32)


def signatures(texts: DataFrame, id_col: str, text: str, hashes: int = HASHES) -> DataFrame:
    """(`id_col`, signature) of the texts that have one."""
    rows = texts.select(F.col(id_col), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [minhash(t, hashes) for t in b.column(1).to_pylist()]
            keep = pa.array([i for i, s in enumerate(made) if s is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([s for s in made if s is not None], pa.list_(pa.int32()))], names=[id_col, "signature"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, signature array<int>")


def pairs_in_buckets(members: DataFrame, keys: list[str], id_col: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float, cell: int = CELL) -> DataFrame:
    """(a, b, score), a < b: pairs of a bucket with a score of at least `least`; each once, whatever number of buckets it shares.

    A bucket of more than `cell` rows is cut into blocks, and each pair of blocks is a task's work, so no task sees an unbounded group.
    """
    sizes = members.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias("_k"), F.count("*").alias("_n")).filter("_n > 1")
    rows = salted_join(members, sizes.select(*keys, "_k"), keys, sizes, F.col(id_col), n="_n")
    own = F.pmod(F.xxhash64(F.lit("cell"), id_col), "_k").cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select(*keys, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") <= F.col("_other")).alias("_low"), F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    return _compared(rows.withColumn("_g", F.xxhash64(*keys)), score, least).dropDuplicates(["a", "b"])


def _compared(rows: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> DataFrame:
    """(a, b, score): the similar pairs of each (_g, _i, _j); many small groups go through one task, which holds one group at a time."""
    compare = _compare(score, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not table.num_rows:
                continue
            key = np.stack([table[c].to_numpy() for c in ("_g", "_i", "_j")])
            edges = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
            found = [compare(table.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]
            yield from pa.concat_tables(found).combine_chunks().to_batches(max_chunksize=100_000) if found else []
            held = table.slice(edges[-1])
        if held is not None and held.num_rows > 1:
            yield from compare(held).to_batches(max_chunksize=100_000)

    slim = rows.select("_g", F.col("_i").cast("long").alias("_i"), F.col("_j").cast("long").alias("_j"), "_low", "id", "vector")
    return slim.repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j").mapInArrow(run, "a bigint, b bigint, score double")


def _compare(score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> Callable[[pa.Table], pa.Table]:
    """All pairs of the blocks _i and _j (or inside one) with a score of at least `least`."""

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        low = group["_low"].to_numpy(zero_copy_only=False)
        same = group["_i"][0].as_py() == group["_j"][0].as_py()
        x = np.stack(group["vector"].to_numpy(zero_copy_only=False)) if len(ids) else np.zeros((0, 1))
        left, right = (x, x) if same else (x[low], x[~low])
        li, ri = (ids, ids) if same else (ids[low], ids[~low])
        out_a, out_b, out_s = [], [], []
        for at in range(0, len(left), 256):
            s = score(left[at : at + 256], right)
            p, q = np.nonzero(s >= least)
            a, b = li[at : at + 256][p], ri[q]
            keep = (a < b) if same else (a != b)
            out_a.append(np.minimum(a, b)[keep]), out_b.append(np.maximum(a, b)[keep]), out_s.append(s[p, q][keep])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"a": cat(out_a, np.int64).astype(np.int64), "b": cat(out_b, np.int64).astype(np.int64), "score": cat(out_s, float).astype(float)})

    return run


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature values of all pairs."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k][:, None] == b[:, k][None, :]
    return out / a.shape[1]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return norm(a.astype(float)) @ norm(b.astype(float)).T


def copies(df: DataFrame, id_col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all rows with a key, and (rep, n); rep is the smallest id of the rows with that key."""
    keyed = cut(df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")).filter(F.col(key).isNotNull() if key in df.columns else F.lit(True)), "keys")
    groups = cut(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    members = salted_join(keyed, groups.drop("n"), ["k1", "k2"], groups, F.col("id")).select("id", "rep")
    return members, groups.select("rep", "n")


def minhash_pairs(texts: DataFrame, id_col: str, text: str, threshold: float = 0.8, bands: int = BANDS, hashes: int = HASHES, cell: int = CELL) -> DataFrame:
    """(a, b, score): pairs of distinct texts that share a band and agree in at least `threshold` of their signature."""
    per = hashes // bands
    signed = cut(signatures(texts, id_col, text, hashes), "signatures")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", i * per + 1, per))))
    banded = signed.select(id_col, band.alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    placed = salted_join(banded, shared.drop("n"), ["band", "bucket"], shared, F.col(id_col))
    return pairs_in_buckets(placed.join(signed, id_col), ["band", "bucket"], id_col, "signature", agreement, threshold, cell)


def verified(pairs: DataFrame, texts: DataFrame, id_col: str, text: str, threshold: float, gram: int = GRAM) -> DataFrame:
    """(a, b, score): the pairs whose sets of character grams have a true similarity of at least `threshold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, scores = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                u, v = ({t[k : k + gram] for k in range(len(t) - gram + 1)} for t in (x, y))
                both = len(u & v)
                score = both / (len(u) + len(v) - both)
                if score >= threshold:
                    keep.append(i), scores.append(score)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(scores, pa.float64())], names=["a", "b", "score"])

    side = lambda c, t: texts.select(F.col(id_col).alias(c), F.col(text).alias(t))
    both = pairs.select("a", "b").join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, score double")


def drop_similar(ids: DataFrame, pairs: DataFrame, mode: str = "any_earlier", chunk: int = CHUNK) -> DataFrame:
    """(id, class_id, n_links, keep) for each id, by its similar pairs (a, b).

    any_earlier drops an id that is similar to any smaller one; greedy drops one that is similar to a smaller kept one, to a
    fixed point; components keeps the smallest id of each connected group. class_id is the smallest id of the connected group.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    pairs = cut(pairs.select("a", "b"), "pairs")
    stars = pairs.select(F.col("a").alias("rec"), F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("rec"), F.col("a").alias("ent")))
    classes = bipartite_components(stars, chunk=chunk).select(F.col("rec").alias("id"), F.col("first").alias("class_id"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    if mode == "any_earlier":
        dropped = pairs.select(F.col("b").alias("id")).distinct()
    elif mode == "components":
        dropped = classes.filter("id != class_id").select("id")
    else:
        dropped = _greedy(pairs)
    return (
        ids.select("id").join(classes, "id", "left").join(links, "id", "left").join(dropped.withColumn("_d", F.lit(True)), "id", "left")
        .select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("_d").isNull().alias("keep"))
    )


def _greedy(pairs: DataFrame) -> DataFrame:
    """Ids that have a smaller kept neighbour. Each round keeps the ids without an undecided smaller neighbour and drops the neighbours of those."""
    left, out, k = pairs, None, 0
    while not left.isEmpty():
        later = left.select(F.col("b").alias("id")).distinct()
        kept = left.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        gone = cut(left.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), f"dropped{k}")
        out = gone if out is None else out.unionByName(gone)
        # dropped ids no longer count for anyone; edges of kept ids are settled
        left = left.join(kept.withColumnRenamed("id", "a"), "a", "left_anti")
        left = left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        left = cut(left, f"undecided{k}")
        k += 1
    return out.distinct() if out is not None else pairs.select(F.col("b").alias("id")).limit(0)


def _expand(members: DataFrame, decided: DataFrame, sizes: DataFrame) -> DataFrame:
    """From representatives to all rows: copies behind the first aren't kept."""
    known = decided.select(F.col("id").alias("rep"), "class_id", "n_links", F.col("keep").alias("_keep"))
    out = salted_join(members, known, ["rep"], sizes, F.col("id"))
    return out.select("id", "class_id", "n_links", (F.col("_keep") & (F.col("id") == F.col("rep"))).alias("keep"))


def dedup_texts(df: DataFrame, id_col: str, text: str = "text", threshold: float = 0.8, mode: str = "any_earlier", bands: int = BANDS, hashes: int = HASHES, cell: int = CELL, exact: bool = False) -> DataFrame:
    """(id, class_id, n_links, keep) of each row: MinHash near-duplicates of whole texts.

    By default the signatures decide, as they estimate. With `exact` pairs whose signatures agree in at least the threshold less four standard errors are verified
    on the texts, so that only pairs that share no band can be missing. Rows with a null text pass through, each a class of its own; texts shorter than the gram only match exact copies.
    """
    members, sizes = copies(df, id_col, text)
    reps = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text")).join(sizes.select("rep"), "rep").dropDuplicates(["rep"])
    slack = 4 * (threshold * (1 - threshold) / hashes) ** 0.5 if exact else 0.0
    pairs = minhash_pairs(reps, "rep", "text", threshold - slack, bands, hashes, cell)
    if exact:
        pairs = verified(pairs, reps, "rep", "text", threshold)
    decided = drop_similar(sizes.select(F.col("rep").alias("id")), pairs, mode)
    out = _expand(members, decided, sizes)
    i = F.col(id_col).cast("long")
    return out.unionByName(df.filter(F.col(text).isNull()).select(i.alias("id"), i.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep")))


def kmeans_clusters(df: DataFrame, id_col: str, vector: str, k: int = 1000, seed: int = 42, sample: int = 100_000, iterations: int = 20) -> DataFrame:
    """(`id_col`, cluster): k-means fitted on at most `sample` rows, every row assigned; k is cut to the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(F.col(id_col), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    n = df.count()
    if min(k, n) < 2:
        return df.select(id_col, F.lit(0).alias("cluster"))
    fit = vectors if n <= sample else vectors.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(sample)
    model = KMeans(k=min(k, n, sample), seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(fit)
    return model.transform(vectors).select(id_col, "cluster")


def cosine_pairs(members: DataFrame, id_col: str, vector: str, least: float, cell: int = CELL) -> DataFrame:
    """(a, b, score), a < b: all pairs with a cosine of at least `least`, inside a cluster or across; each once.

    Clusters of more than `cell` rows are cut into blocks. Two blocks are compared unless the angle between their centres less
    both radii is beyond that of `least`, which by the triangle inequality leaves no such pair. Where nothing can be ruled
    out a row is sent to each block, so clusters shouldn't be much smaller than a cell.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / cell).alias("_k"))
    own = F.pmod(F.xxhash64(F.lit("cell"), id_col), "_k")
    rows = cut(members.join(F.broadcast(sizes), "cluster").select((F.col("cluster").cast("long") * (1 << 32) + own).alias("block"), F.col(id_col).alias("id"), F.col(vector).alias("vector")), "blocks")  # sizes: a row a cluster

    def bound(group: pa.Table) -> pa.Table:
        x = np.stack(group["vector"].to_numpy(zero_copy_only=False)).astype(float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centre = x.mean(axis=0)
        centre = centre / np.maximum(np.linalg.norm(centre), 1e-12)
        radius = np.arccos(np.clip(x @ centre, -1, 1)).max()
        return pa.table({"block": group["block"][:1], "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [float(radius)]})

    bounds = cut(rows.groupBy("block").applyInArrow(bound, "block bigint, centre array<double>, radius double"), "bounds")
    left, right = (bounds.select(*[F.col(c).alias(f"{c}{side}") for c in bounds.columns]) for side in ("_i", "_j"))
    cosine = F.aggregate(F.zip_with("centre_i", "centre_j", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("radius_i") - F.col("radius_j")
    near = F.lit(True) if least <= 0 else F.isnan(gap) | (gap <= float(np.arccos(min(least, 1.0))) + 1e-6)
    met = left.crossJoin(right).filter(F.col("block_i") <= F.col("block_j")).filter((F.col("block_i") == F.col("block_j")) | near)
    met = cut(met.select(F.col("block_i").alias("_i"), F.col("block_j").alias("_j")), "met")
    low = met.select(F.col("_i").alias("block"), "_i", "_j", F.lit(True).alias("_low"))
    high = met.filter("_i < _j").select(F.col("_j").alias("block"), "_i", "_j", F.lit(False).alias("_low"))
    sent = rows.join(low.unionByName(high), "block").select("_i", "_j", "_low", "id", "vector")
    return _compared(sent.withColumn("_g", F.lit(0).cast("long")), cosines, least)


def dedup_embeddings(df: DataFrame, id_col: str, vector: str, threshold: float = 0.95, mode: str = "any_earlier", cluster: str | None = None, k: int = 1000, cell: int = CELL) -> DataFrame:
    """(id, class_id, n_links, keep): rows whose embeddings have a cosine of at least `threshold`.

    With the column `cluster`, inside its values only. Else among all rows: k-means (at most `k` clusters, of LEAST rows on
    average) only tells which rows needn't be compared. Rows with a null or empty embedding pass through.
    """
    rows = df.filter(F.size(vector) > 0)
    members, sizes = copies(rows.withColumn("_json", F.to_json(F.struct(vector, *([cluster] if cluster else [])))), id_col, "_json")
    reps = rows.withColumn("rep", F.col(id_col).cast("long")).join(sizes.select("rep"), "rep").dropDuplicates(["rep"])
    slim = reps.select("rep", F.col(vector).alias("vector"), *([F.col(cluster).alias("cluster")] if cluster else []))
    if cluster:
        pairs = pairs_in_buckets(cut(slim, "clusters"), ["cluster"], "rep", "vector", cosines, threshold, cell)
    else:
        slim = cut(slim, "vectors")
        clustered = slim.join(kmeans_clusters(slim, "rep", "vector", min(k, max(1, slim.count() // LEAST))), "rep")
        pairs = cosine_pairs(clustered, "rep", "vector", threshold, cell)
    out = _expand(members, drop_similar(sizes.select(F.col("rep").alias("id")), pairs, mode), sizes)
    i = F.col(id_col).cast("long")
    none = df.filter(F.coalesce(F.size(vector) <= 0, F.lit(True)))
    return out.unionByName(none.select(i.alias("id"), i.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep")))


def dedup_sequences(df: DataFrame, id_col: str, sequence: str) -> DataFrame:
    """(id, class_id, n_links, keep): equal sequences; all nulls are equal to each other."""
    keyed = df.withColumn("_json", F.coalesce(F.to_json(F.struct(sequence)), F.lit("")))
    members, sizes = copies(keyed, id_col, "_json")
    out = salted_join(members, sizes.select("rep"), ["rep"], sizes, F.col("id"))
    return out.select("id", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("n_links"), (F.col("id") == F.col("rep")).alias("keep"))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 10, metric: str = "l2", most: float | None = None, block: int = 5_000) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, ascending, ties by id; at most `most` away.

    Queries are sent in blocks of `block`, so what a task holds is bounded; each task gives its own k nearest of each query first.
    """
    spark = rows.sparkSession
    asked = cut(queries.select(F.col(id_col).cast("long").alias("q"), F.col(vector).alias("v")).withColumn("_at", F.pmod(F.xxhash64("q"), F.lit(1 << 20))), "queries")
    n = asked.count()
    blocks = max(1, -(-n // block))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    found = None
    for i in range(blocks):
        part = asked.filter((F.col("_at") * blocks >= i * (1 << 20)) & (F.col("_at") * blocks < (i + 1) * (1 << 20))).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part["q"].to_numpy(), np.stack(part["v"].to_numpy(zero_copy_only=False)).astype(float)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qs, qv = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                d = 1 - cosines(qv, x) if metric == "cosine" else np.sqrt(np.maximum((qv**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * qv @ x.T, 0))
                order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["query_id", "id", "distance"])

        one = slim.mapInArrow(run, "query_id bigint, id bigint, distance double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = slim.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance")).limit(0)
    if most is not None:
        found = found.filter(F.col("distance") <= most)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
