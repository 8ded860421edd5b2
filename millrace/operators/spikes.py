"""Implausible readings in measurement series, relative to each source's normal behaviour.

A series is one metric of one source (and device), ordered by time. Its undecimated Haar wavelet details at dilation k are the
differences of readings k apart. The robust scale is the median magnitude of the details at the finest scale. A burst of n readings is
opened by details of dilations 1 to n beyond `factor` scales in one direction and closed by details of dilations 1 to n beyond it in the other,
runs of zero details are stuck sensors, and fixed bounds catch what can't occur.

The rows are range-partitioned by (source, time), so a source of any size is spread over many blocks of bounded size. A
source that lies inside one block is decided there. For a source that reaches over block borders, each block gives its
distinct detail magnitudes with counts, the thresholds up to which its details make bursts and the readings next to its borders; the exact scale of
the whole series, and the few cases that cross a border, follow from those. Borders are joined in a tree of bounded width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


@dataclass(frozen=True)
class Metric:
    """A measured column; `high` is a SQL expression for the largest possible value (null: no bound).

    With `per_device` the column is an array with one element a device and `high` may be an array as well.
    """

    name: str
    high: str
    per_device: bool = False
    low: float = 0.0


SNAPSHOT_METRICS = (
    Metric("cpu_percent", "100.0 * cpu_count"),
    Metric("gpu_temperature", "120.0", per_device=True),
    Metric("gpu_memory_used_mb", "gpu_memory_total_mb", per_device=True),
)
FACTOR = 12.0
STUCK = 12
BURST = 3
#: Rows of one block.
BLOCK_ROWS = 50_000
#: Neighbouring parts of a series that one task joins.
FAN = 1_000

_DOUBLES = pa.list_(pa.float64())
_PARTIAL = {"w": pa.string(), "metric": pa.string(), "device": pa.int32(), "block": pa.int32(), "n": pa.int64()} | {
    k: _DOUBLES for k in ("mag", "mag_n", "val", "val_n", "ht", "hx", "tt", "tx", "ct", "cm", "rt")
}
_OUT = pa.schema([("final", pa.bool_()), ("ts", pa.float64()), *_PARTIAL.items()])
_DDL = (
    "final boolean, ts double, w string, metric string, device int, block int, n bigint, "
    + ", ".join(f"{k} array<double>" for k in list(_PARTIAL)[5:])
)
_SERIES = ["w", "metric", "device"]


def details(x: np.ndarray) -> np.ndarray:
    """Finest-scale undecimated Haar details: differences of successive readings (inf - inf counts as no change)."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.diff(x), nan=0.0, posinf=np.inf, neginf=-np.inf)


def runs(x: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Mask of readings in a run of at least `least` equal successive readings (zero details)."""
    n = len(x)
    out = np.zeros(n, bool)
    if n < least:
        return out
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    start, end = np.r_[0, edge], np.r_[edge, n]
    for k in np.flatnonzero(end - start >= least):
        out[start[k] : end[k]] = True
    return out


def coefficients(x: np.ndarray, longest: int = BURST) -> list[np.ndarray]:
    """Undecimated Haar details at the dilations 1 to `longest`: the k-th has x[i] - x[i - k] at i, and 0 where there is no x[i - k]."""
    out = []
    for k in range(1, longest + 1):
        d = np.zeros(len(x))
        with np.errstate(invalid="ignore"):
            d[k:] = np.nan_to_num(x[k:] - x[:-k], nan=0.0, posinf=np.inf, neginf=-np.inf)
        out.append(d)
    return out


def margins(x: np.ndarray, onsets: np.ndarray | None = None, longest: int = BURST) -> np.ndarray:
    """The largest threshold at which the details still make each reading part of a burst of up to `longest` readings, 0
    where they don't. `onsets`: only bursts that start at these positions, where the finest detail is beyond the threshold already."""
    n = len(x)
    out = np.zeros(n)
    d = coefficients(x, longest)
    for length in range(1, longest + 1):
        if n < length + 2:
            break
        i = np.arange(1, n - length) if onsets is None else onsets[(onsets >= 1) & (onsets < n - length)]
        if not len(i):
            continue
        # details from the reading before to each of the burst, and from each of the burst to the reading behind
        opening = np.stack([d[k][i + k] for k in range(length)])
        closing = -np.stack([d[k][i + length] for k in range(length)])
        m = np.maximum(np.minimum(opening.min(axis=0), closing.min(axis=0)), np.minimum((-opening).min(axis=0), (-closing).min(axis=0)))
        keep = m > 0
        for k in range(length):
            np.maximum.at(out, i[keep] + k, m[keep])
    return out


def majority(x: np.ndarray) -> bool:
    """Whether a single value makes up more than half of the readings. Such a value is the median."""
    return len(x) > 0 and 2 * np.count_nonzero(x == np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]) > len(x)


def implausible(x: np.ndarray, factor: float = FACTOR) -> np.ndarray:
    """Mask of stuck and burst readings of one whole series."""
    stuck = runs(x)
    if stuck.any() and majority(x):
        stuck[:] = False
    if len(x) < 3:
        return stuck
    d = details(x)
    limit = factor * np.median(np.abs(d))
    onsets = np.flatnonzero(np.abs(d) > limit) + 1
    return stuck | (margins(x, onsets) > limit) if len(onsets) else stuck


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _read_metric(table: pa.Table, k: int, per_device: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(readings, highest possible) of each device, one value a row, NaN where there is none."""
    value, high = _whole(table[f"v{k}"]), _whole(table[f"h{k}"])
    n = len(value)
    if not per_device:
        return [(_doubles(value), _doubles(high))]

    def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return _doubles(pc.list_flatten(column)), np.cumsum(size) - size, size

    flat, at, size = split(value)
    lists = pa.types.is_list(high.type)
    hflat, hat, hsize = split(high) if lists else (_doubles(high), None, None)
    out = []
    for d in range(int(size.max(initial=0))):
        x, h = np.full(n, np.nan), np.full(n, np.nan)
        has = size > d
        x[has] = flat[at[has] + d]
        if lists:
            hhas = hsize > d
            h[hhas] = hflat[hat[hhas] + d]
        else:
            h = hflat
        out.append((x, h))
    return out


def _block(metrics: tuple[Metric, ...], factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        block = TaskContext.get().partitionId()
        w = _whole(table["w"]).to_numpy(zero_copy_only=False)
        ts = _doubles(_whole(table["ts"]))
        edge = np.flatnonzero(w[1:] != w[:-1]) + 1
        segments = list(zip(np.r_[0, edge], np.r_[edge, len(w)]))
        rows: dict[str, list] = {k: [] for k in _OUT.names}

        def final(worker, metric, device, times):
            m = len(times)
            for k, v in (("final", [True] * m), ("ts", list(times)), ("w", [worker] * m), ("metric", [metric] * m), ("device", [device] * m)):
                rows[k].extend(v)
            for k in list(_PARTIAL)[3:]:
                rows[k].extend([None] * m)

        for k, metric in enumerate(metrics):
            for d, (values, highs) in enumerate(_read_metric(table, k, metric.per_device)):
                device = d if metric.per_device else -1
                with np.errstate(invalid="ignore"):
                    cannot = (values < metric.low) | (values > highs)
                there = ~np.isnan(values)
                for s, (a, b) in enumerate(segments):
                    own = np.flatnonzero(there[a:b]) + a
                    x, t, worker = values[own], ts[own], w[a]
                    bad = cannot[own]
                    if s in (0, len(segments) - 1):
                        if len(own):
                            _partial(rows, worker, metric.name, device, block, x, t)
                    else:
                        bad = bad | implausible(x, factor)
                    if bad.any():
                        final(worker, metric.name, device, t[bad])
        yield from pa.Table.from_pydict(rows, schema=_OUT).to_batches(max_chunksize=20_000)

    return run


def _partial(rows: dict[str, list], worker: str, metric: str, device: int, block: int, x: np.ndarray, t: np.ndarray) -> None:
    mag, mag_n = np.unique(np.abs(details(x)), return_counts=True)
    val, val_n = np.unique(x, return_counts=True)
    short = len(x) <= 2 * STUCK
    m, stuck = margins(x), runs(x)
    out = m > 0
    add = {
        "final": False, "ts": None, "w": worker, "metric": metric, "device": device, "block": block, "n": len(x),
        "mag": mag, "mag_n": mag_n.astype(float), "val": val, "val_n": val_n.astype(float),
        "ht": t if short else t[:STUCK], "hx": x if short else x[:STUCK],
        "tt": t[:0] if short else t[-STUCK:], "tx": x[:0] if short else x[-STUCK:],
        "ct": t[out], "cm": m[out], "rt": t[stuck],
    }
    for k, v in add.items():
        rows[k].append(v)


_BORDERS = "w string, metric string, device int, kind string, ts double, m double, block long, hx array<double>, ht array<double>, tx array<double>, tt array<double>"


def _borders(key, pdf):
    """Details, bursts and runs that cross a border between neighbouring parts of one series, and the outer readings of all of them as one larger part."""
    import pandas as pd

    pdf = pdf.sort_values("block")
    x, t, owner, gaps = [], [], [], []
    for r in pdf.itertuples():
        for xs, ts in ((r.hx, r.ht), (r.tx, r.tt)):
            if len(xs):
                x.append(np.asarray(xs, float)), t.append(np.asarray(ts, float)), owner.append(np.full(len(xs), r.block))
        if len(r.tx):
            # the readings between head and tail aren't here: nothing may reach over them
            gaps.append(sum(map(len, x)) - len(r.tx))
    found = []
    if x:
        x, t, owner = map(np.concatenate, (x, t, owner))
        for a, b in zip([0, *gaps], [*gaps, len(x)]):
            xs, ts, os = x[a:b], t[a:b], owner[a:b]
            crossing = os[1:] != os[:-1]
            found += [("detail", 0.0, v) for v in np.abs(details(xs))[crossing]]
            m = margins(xs)
            found += [("burst", ts[i], m[i]) for i in np.flatnonzero(m > 0)]
            found += [("stuck", ts[i], 0.0) for i in np.flatnonzero(runs(xs))]
    out = pd.DataFrame(found, columns=["kind", "ts", "m"])
    for c in ("block", "hx", "ht", "tx", "tt"):
        out[c] = None
    if len(x):
        short = not gaps and len(x) <= 2 * STUCK
        part = {"kind": "part", "ts": None, "m": None, "block": int(key[3]), "hx": x if short else x[:STUCK], "ht": t if short else t[:STUCK], "tx": x[:0] if short else x[-STUCK:], "tt": t[:0] if short else t[-STUCK:]}
        out = pd.concat([out, pd.DataFrame([part])]) if len(out) else pd.DataFrame([part])
    for k, v in zip(_SERIES, key):
        out[k] = v
    return out[["w", "metric", "device", "kind", "ts", "m", "block", "hx", "ht", "tx", "tt"]]


def _crossing(partial: DataFrame, blocks: int, fan: int) -> DataFrame:
    """(series, kind, ts, m): what crosses borders. Each task joins at most `fan` neighbouring parts of a series; the parts so made are joined again until one is left."""
    parts, found, left = partial.select(*_SERIES, F.col("block").cast("long").alias("block"), "hx", "ht", "tx", "tt"), None, blocks
    while True:
        out = cut(parts.withColumn("_up", F.floor(F.col("block") / fan)).groupBy(*_SERIES, "_up").applyInPandas(_borders, _BORDERS), "borders")
        new = out.filter("kind != 'part'").select(*_SERIES, "kind", "ts", "m")
        found = new if found is None else found.unionByName(new)
        left = -(-left // fan)
        if left <= 1:
            return found
        parts = out.filter("kind = 'part'").select(*_SERIES, "block", "hx", "ht", "tx", "tt")


def weighted_median(counted: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """(`keys`, median): exact median of values given with counts.

    First the bucket that holds the middle is found among logarithmic buckets (a bounded number for each key), then the
    middle inside it, so no task needs all distinct values of a key.
    """
    one = counted.groupBy(*keys, value).agg(F.sum(n).alias("_c"))
    one = one.withColumn("_b", F.when(F.col(value) > 0, F.floor(F.log2(value) * 64)).otherwise(-(10**6)).cast("long"))
    buckets = one.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    over = Window.partitionBy(*keys)
    buckets = (
        buckets.withColumn("_before", F.sum("_bc").over(over.orderBy("_b")) - F.col("_bc"))
        .withColumn("_n", F.sum("_bc").over(over))
        .withColumn("_k1", F.floor((F.col("_n") - 1) / 2)).withColumn("_k2", F.floor(F.col("_n") / 2))
        .filter("_before <= _k2 and _before + _bc > _k1")
    )
    inside = one.join(buckets, [*keys, "_b"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value))
    inside = inside.withColumn("_upto", upto)
    holds = lambda k: (F.col("_upto") - F.col("_c") <= F.col(k)) & (F.col("_upto") > F.col(k))
    return inside.groupBy(*keys).agg(
        ((F.max(F.when(holds("_k1"), F.col(value))) + F.max(F.when(holds("_k2"), F.col(value)))) / 2).alias("median")
    )


def implausible_readings(
    df: DataFrame, metrics: tuple[Metric, ...] = SNAPSHOT_METRICS, *, id_col: str = "snapshot_id", source: str = "worker_id",
    time: str = "timestamp", factor: float = FACTOR, block_rows: int = BLOCK_ROWS, blocks: int | None = None, fan: int = FAN,
) -> DataFrame:
    """(`id_col`, metric, device): one row for each implausible reading; device is -1 for a metric without devices.

    A reading is implausible if it is below `low` or above `high`, if it is one of at least 12 equal successive readings
    in a series where no single value makes up more than half, or if it is in a burst of one to three readings that all
    lie above (or all below) both readings next to the burst by more than `factor` median detail magnitudes.
    Null and NaN readings are in no series. Rows with equal source and time are copies: they count as one reading, taken
    (each device by itself) from the copy with the smallest id that has one, and are flagged together. A null source is a source of its own. Rows
    with a null or NaN time belong to no series; only the bounds are tested on them. An unknown upper bound
    isn't tested. Rows with a null id are read but can't be reported. An empty table gives an empty result; other
    columns don't matter, whatever their names.
    """
    spark = df.sparkSession
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    taken: list[Column] = [key.alias("w"), F.nanvl(F.col(time).cast("double"), F.lit(None)).alias("ts"), F.col(id_col).alias("id")]
    for k, m in enumerate(metrics):
        taken += [F.col(m.name).alias(f"v{k}"), F.expr(m.high).alias(f"h{k}")]
    base = df.select(*taken)
    kinds = dict(base.dtypes)
    widths = base.agg(F.count("*").alias("n"), *[F.max(F.size(f"v{k}")).alias(f"v{k}") for k, m in enumerate(metrics) if m.per_device]).first()
    aggs, made = [], []
    for k, m in enumerate(metrics):
        v, h = F.col(f"v{k}"), F.col(f"h{k}")
        places = range(widths[f"v{k}"] or 0) if m.per_device else [None]
        xs = [F.nanvl((v if i is None else F.get(v, F.lit(i))).cast("double"), F.lit(None)) for i in places]
        hs = [(F.get(h, F.lit(i)) if kinds[f"h{k}"].startswith("array") else h).cast("double") for i in places]
        for i, (x, top) in enumerate(zip(xs, hs)):
            known = x.isNotNull()
            aggs += [F.min_by(x, F.when(known, F.col("id"))).alias(f"v{k}_{i}"), F.min_by(top, F.when(known & top.isNotNull(), F.col("id"))).alias(f"h{k}_{i}")]
        if m.per_device:
            aggs.append(F.coalesce(F.max(F.size(v)), F.lit(0)).alias(f"n{k}"))
            made += [F.slice(F.array(*[F.col(f"{c}{k}_{i}") for i in places]).cast("array<double>"), F.lit(1), F.greatest(f"n{k}", F.lit(0))).alias(f"{c}{k}") for c in "vh"]
        else:
            made += [F.col(f"{c}{k}_0").alias(f"{c}{k}") for c in "vh"]
    readings = base.filter("ts is not null").groupBy("w", "ts").agg(*aggs).select("w", "ts", *made)
    untimed = base.filter("ts is null").select("id", F.explode(F.array(*[_bounds(m, k, kinds[f"h{k}"].startswith("array")) for k, m in enumerate(metrics)])).alias("u")).select("id", "u.*")
    blocks = blocks or max(spark.sparkContext.defaultParallelism, -(-widths["n"] // block_rows))
    placed = readings.repartitionByRange(blocks, "w", "ts").sortWithinPartitions("w", "ts")
    out = cut(placed.mapInArrow(_block(metrics, factor), _DDL), "blocks")

    partial = out.filter("not final")
    crossing = _crossing(partial, blocks, fan)
    one = F.lit(1.0).alias("c")
    mags = partial.select(*_SERIES, F.explode(F.arrays_zip("mag", "mag_n")).alias("z")).select(*_SERIES, F.col("z.mag").alias("x"), F.col("z.mag_n").alias("c"))
    mags = mags.unionByName(crossing.filter("kind = 'detail'").select(*_SERIES, F.col("m").alias("x"), one))
    scale = weighted_median(mags, _SERIES, "x", "c")
    peaks = partial.select(*_SERIES, F.explode(F.arrays_zip("ct", "cm")).alias("z")).select(*_SERIES, F.col("z.ct").alias("ts"), F.col("z.cm").alias("m"))
    peaks = peaks.unionByName(crossing.filter("kind = 'burst'").select(*_SERIES, "ts", "m"))
    bursts = peaks.join(scale, _SERIES).filter(F.col("m") > factor * F.col("median")).select(*_SERIES, "ts")

    stuck = partial.select(*_SERIES, F.explode("rt").alias("ts")).unionByName(crossing.filter("kind = 'stuck'").select(*_SERIES, "ts"))
    values = (
        partial.select(*_SERIES, "n", "val", "val_n").join(stuck.select(*_SERIES).distinct(), _SERIES, "left_semi")
        .select(*_SERIES, F.explode(F.arrays_zip("val", "val_n")).alias("z"))
        .groupBy(*_SERIES, F.col("z.val").alias("x")).agg(F.sum("z.val_n").alias("c"))
        .groupBy(*_SERIES).agg(F.max("c").alias("most"), F.sum("c").alias("n")).filter("2 * most <= n")
    )
    stuck = stuck.join(values, _SERIES, "left_semi")

    cases = out.filter("final").select(*_SERIES, "ts").unionByName(bursts).unionByName(stuck).distinct()
    ids = base.select("w", "ts", "id").filter("ts is not null")
    named = cases.join(ids, ["w", "ts"]).select("id", "metric", "device")
    named = named.unionByName(_untimed(untimed))
    return named.filter("id is not null").select(F.col("id").alias(id_col), "metric", "device")


def _bounds(m: Metric, k: int, array_bound: bool) -> Column:
    """The bounds of rows without a time: the metric, its first device and an array of flags, one a device."""
    v, h = F.col(f"v{k}"), F.col(f"h{k}")
    low = F.lit(m.low)

    def bad(x: Column, top: Column) -> Column:
        return F.coalesce(~F.isnan(x) & ((x < low) | F.coalesce((x > top) & ~F.isnan(top), F.lit(False))), F.lit(False))

    if not m.per_device:
        flags = F.array(bad(v, h))
    else:
        top = (lambda i: F.get(h, i)) if array_bound else (lambda i: h)
        flags = F.transform(v, lambda x, i: bad(x, top(i)))
    return F.struct(F.lit(m.name).alias("metric"), F.lit(0 if m.per_device else -1).alias("base"), flags.alias("flags"))


def _untimed(u: DataFrame) -> DataFrame:
    return u.select("id", "metric", "base", F.posexplode("flags").alias("i", "is")).filter("is").select("id", "metric", (F.col("base") + F.col("i")).cast("int").alias("device"))
