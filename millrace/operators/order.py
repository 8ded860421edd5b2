"""Global row numbers and joins by order: row index, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row") -> DataFrame:
    """Number rows from 0 in `order_by` order without one task seeing them all.

    Rows are range-partitioned and numbered inside each partition; the sizes of the partitions before are added. Ties are in no fixed order.
    """
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row a partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


#: Rows of one key above which a window by key is spread over tasks.
HOT = 5_000_000


def has_hot(df: DataFrame, by: list[str], rows: int | None = None) -> bool:
    """Whether a key holds more than `rows` rows (without keys: whether the table does); counted with map-side combining."""
    return (df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > (HOT if rows is None else rows)


def running(df: DataFrame, by: list[str], order_by: list[str], columns: dict[str, tuple[str, str | None]], backward: bool = False) -> DataFrame:
    """Running values per key for keys of any size: name -> (kind, column).

    Kinds: row_number; sum; last_known, the last value that isn't null up to the row; lag, the value of the row before.
    Rows are range-partitioned by key and order, so a hot key is spread over many tasks. Each task works on its stretch;
    what a stretch hands on to the next one of its key is a summary of one row. Equals the window function of that name; ties are in no fixed order.
    With `backward` rows are taken in the opposite order.
    """
    kinds = {k for k, _ in columns.values()}
    if not kinds <= {"row_number", "sum", "last_known", "lag"}:
        raise ValueError(f"unknown kinds {kinds}")
    order = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order_by]
    last_by = F.min_by if backward else F.max_by
    placed = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "stretches")
    w = Window.partitionBy("_p", *by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local: dict[str, Column] = {"_first": F.row_number().over(w) == 1}
    ends, carried, final = [], [], {}
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    at = F.struct(*order_by)
    for i, (name, (kind, c)) in enumerate(columns.items()):
        own, carry = F.col(f"_own{i}"), F.col(f"_carry{i}")
        if kind == "row_number":
            local[f"_own{i}"] = F.row_number().over(w)
            ends.append(F.count("*").alias(f"_end{i}"))
        elif kind == "sum":
            local[f"_own{i}"] = F.sum(c).over(upto)
            ends.append(F.sum(c).alias(f"_end{i}"))
        elif kind == "last_known":
            local[f"_own{i}"] = F.last(c, ignorenulls=True).over(upto)
            ends.append(last_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end{i}"))
        else:
            local[f"_own{i}"] = F.lag(c).over(w)
            ends.append(last_by(F.struct(F.col(c).alias("v")), at).alias(f"_end{i}"))
        end = F.col(f"_end{i}")
        carried.append((F.sum(end) if kind in ("row_number", "sum") else F.last(end, ignorenulls=True)).over(before).alias(f"_carry{i}"))
        if kind == "row_number":
            final[name] = own + F.coalesce(carry, F.lit(0))
        elif kind == "sum":
            final[name] = F.coalesce(own + carry, own, carry)
        elif kind == "last_known":
            final[name] = F.coalesce(own, carry)
        else:
            final[name] = F.when(F.col("_first"), carry["v"]).otherwise(own)
    keys = {k: F.col(k).alias(f"_k{i}") for i, k in enumerate(by)}
    summary = placed.groupBy("_p", *by).agg(*ends).select(F.col("_p").alias("_q"), *keys.values(), *carried)
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.withColumns(local).join(summary, same).select(*df.columns, *[c.alias(k) for k, c in final.items()])


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], right_time: str | None = None, tolerance: Column | None = None, split_hot: bool | None = None) -> DataFrame:
    """For each left row the values of the last right row of the same `by` at or before its time; null if there is none.

    One shuffle: both sides are put in one timeline and the last known values are carried forward. At equal times the
    right row counts as before; among right rows of one time the one with the greatest values counts. With `split_hot` keys
    are spread over tasks; without a word it is done where a key has more rows than HOT, for which both sides are counted.
    """
    rt = right_time or time
    l = left.withColumns({"_side": F.lit(1), "_t": F.col(time), "_left": F.struct(*left.columns), "_v": F.lit(None)})
    pick = F.struct(F.col(rt).alias("_rt"), *values)
    r = right.select(*by, F.lit(0).alias("_side"), F.col(rt).alias("_t"), pick.alias("_v"))
    both = l.select(*by, "_side", "_t", "_left").unionByName(r, allowMissingColumns=True)
    if split_hot is None:
        split_hot = has_hot(left.select(*by).unionByName(right.select(*by)), by)
    if split_hot:
        out = running(both, by, ["_t", "_side", "_v"], {"_last": ("last_known", "_v")}).filter("_side = 1")
    else:
        w = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    known = F.col("_last")
    if tolerance is not None:
        known = F.when(F.col("_t") - F.col("_last._rt") <= tolerance, known)
    return out.select("_left.*", known.alias("_last")).select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ranges low <= point <= high that hold them, as an equi-join on buckets of `width`.

    Each range is repeated once for each bucket that it touches; choose `width` near the usual length of a range.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [*(by or []), "_b"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b")


def nearest_join(left: DataFrame, right: DataFrame, time: str, key: str, by: list[str], values: list[str], tolerance: float) -> DataFrame:
    """For each left row (unique `key`) the values of the right row of the same `by` nearest in time within `tolerance`, else null."""
    r = right.select(*by, F.col(time).alias("_rt"), *values)
    lo = left.select(key, *by, F.col(time).alias("_lt")).withColumn("_lo", F.col("_lt") - tolerance).withColumn("_hi", F.col("_lt") + tolerance)
    near = range_join(r, lo, "_rt", "_lo", "_hi", max(2 * tolerance, 1e-9), by)
    best = near.groupBy(key).agg(F.min_by(F.struct("_rt", *values), F.struct(F.abs(F.col("_rt") - F.col("_lt")), F.col("_rt"))).alias("_best"))
    return left.join(best, key, "left").select(*left.columns, F.col("_best").isNotNull().alias("aligned"), *[F.col(f"_best.{v}").alias(v) for v in values])
