"""Column statistics, outliers, drift and balance over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _known(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, value): exact quantiles of all rows with linear interpolation; null where a column has no value.

    Values are counted first and range-partitioned; the counts of the partitions before give each value its rank, so no task
    and no aggregation buffer holds all values of a column.
    """
    from millrace.session import cut

    x = [F.struct(F.lit(c).alias("column"), _known(df, c).cast("double").alias("x")) for c in columns]
    counted = df.select(F.explode(F.array(*x)).alias("z")).select("z.*").filter("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    placed = cut(counted.repartitionByRange("column", "x").withColumn("_p", F.spark_partition_id()), "counted")
    starts = placed.groupBy("column", "_p").agg(F.sum("n").alias("_n"))  # one row a column and partition
    of = Window.partitionBy("column")
    starts = starts.select("column", "_p", (F.sum("_n").over(of.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("_all"))
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("column", "_p").orderBy("x"))
    ranked = placed.join(starts, ["column", "_p"]).withColumn("_upto", upto)
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    ranked = ranked.withColumn("share", asked).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    holds = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("n") <= k)
    low, high = F.floor("_at"), F.ceil("_at")
    ends = ranked.filter(holds(low) | holds(high)).groupBy("column", "share").agg(
        F.max(F.when(holds(low), F.col("x"))).alias("lo"), F.max(F.when(holds(high), F.col("x"))).alias("hi"), F.first(F.col("_at") - low).alias("part")
    )
    return ends.select("column", "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, missing, distinct, mean, std, min, max, median): one row a column.

    `std` is the population's; `distinct` is approximate. Columns without numbers have counts only.
    """
    names = columns or df.columns
    numeric = set(_numeric(df))
    aggs = []
    for c in names:
        x = _known(df, c)
        parts = [F.count(x).alias("count"), (F.count("*") - F.count(x)).alias("missing"), F.approx_count_distinct(x).alias("distinct")]
        if c in numeric:
            d = x.cast("double")
            parts += [F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max")]
        else:
            parts += [F.max(F.lit(None).cast("double")).alias(k) for k in ("mean", "std", "min", "max")]
        aggs.append(F.struct(F.first(F.lit(c)).alias("column"), *parts).alias(f"_{len(aggs)}"))
    one = df.agg(*aggs)
    out = one.select(F.explode(F.array(*one.columns)).alias("p")).select("p.*")
    numbers = [c for c in names if c in numeric]
    if not numbers:
        return out.withColumn("median", F.lit(None).cast("double"))
    middle = quantiles(df, numbers, [0.5]).select("column", F.col("value").alias("median"))
    return out.join(F.broadcast(middle), "column", "left")  # one row a column


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """(column, q1, q3, outliers): values beyond `factor` quartile ranges; none for up to four values or no range."""
    names = columns or _numeric(df)
    found = quantiles(df, names, [0.25, 0.75])
    value = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    quarts = found.agg(*[F.array(value(c, 0.25), value(c, 0.75)).alias(f"q_{c}") for c in names]).join(F.broadcast(df.agg(*[F.count(c).alias(f"n_{c}") for c in names])), how="cross")
    joined = df.select(*names).join(F.broadcast(quarts), how="cross")  # one row

    def outside(c: str) -> Column:
        lo, hi = F.get(f"q_{c}", F.lit(0)), F.get(f"q_{c}", F.lit(1))
        r = (hi - lo) * factor
        return (F.col(f"n_{c}") > 4) & (r > 0) & ((F.col(c) < lo - r) | (F.col(c) > hi + r))

    counted = joined.agg(*[F.struct(
        F.first(F.lit(c)).alias("column"), F.first(F.get(f"q_{c}", F.lit(0))).alias("q1"), F.first(F.get(f"q_{c}", F.lit(1))).alias("q3"),
        F.coalesce(F.sum(outside(c).cast("long")), F.lit(0)).alias("outliers"),
    ).alias(f"_{i}") for i, c in enumerate(names)])
    return counted.select(F.explode(F.array(*counted.columns)).alias("p")).select("p.*")


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_rate): null or NaN."""
    names = columns or df.columns
    one = df.agg(*[F.struct(
        F.first(F.lit(c)).alias("column"), (F.count("*") - F.count(_known(df, c))).alias("missing_count"),
        ((F.count("*") - F.count(_known(df, c))) / F.count("*")).alias("missing_rate"),
    ).alias(f"_{i}") for i, c in enumerate(names)])
    return one.select(F.explode(F.array(*one.columns)).alias("p")).select("p.*")


def with_statistics(df: DataFrame, columns: list[str], metrics: tuple[str, ...] = ("mean", "std", "min", "max", "median"), zscore: bool = True, ddof: int = 1) -> DataFrame:
    """Add <column>_<metric> of the whole table to each row, and <column>_zscore (null where the deviation is 0 or null)."""
    fns = {"mean": F.avg, "std": F.stddev_samp if ddof else F.stddev_pop, "min": F.min, "max": F.max}
    need = dict.fromkeys([*metrics, *(("mean", "std") if zscore else ())])
    one = df.agg(*[fns[m](c).alias(f"{c}_{m}") for c in columns for m in need if m != "median"])
    if "median" in need:
        found = quantiles(df, columns, [0.5])
        one = one.join(F.broadcast(found.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in columns])), how="cross")
    out = df.join(F.broadcast(one), how="cross")  # one row
    if zscore:
        out = out.withColumns({f"{c}_zscore": F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")) for c in columns})
    return out.drop(*[f"{c}_{m}" for c in columns for m in need if m not in metrics])


def drift_reference(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(mean, std, low, high) of the whole reference; `bins` equal bins lie between low and high."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))


def _binned(df: DataFrame, column: str, edges: DataFrame, bins: int) -> DataFrame:
    x = F.col(column).cast("double")
    width = (F.col("high") - F.col("low")) / bins
    k = F.when(width > 0, F.least(F.greatest(F.floor((x - F.col("low")) / width), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    return df.select(column).filter(F.col(column).isNotNull()).join(F.broadcast(edges), how="cross").groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(psi): population stability index on the reference's bins; values outside count to the outer bins."""
    edges = drift_reference(reference, column, bins)
    part = lambda d, name: _binned(d, column, edges, bins).select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    both = part(reference, "p").join(part(current, "q"), "bin", "outer").fillna(0.0, ["p", "q"])
    p, q = F.col("p") + 1e-10, F.col("q") + 1e-10
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(ks): exact two-sample statistic, the greatest distance of the cumulative distributions.

    Both sides are counted by value first; the running sums go over value ranges, so no task needs all values.
    """
    one = lambda d, a, b: d.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")).select("x", (F.lit(a) * F.col("n")).alias("a"), (F.lit(b) * F.col("n")).alias("b"))
    counted = one(reference, 1, 0).unionByName(one(current, 0, 1)).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = counted.repartitionByRange("x").withColumn("_p", F.spark_partition_id())
    from millrace.session import cut

    placed = cut(placed, "ks")
    starts = placed.groupBy("_p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    over = Window.orderBy("_p")  # one row a partition
    starts = starts.select("_p", (F.sum("sa").over(over) - F.col("sa")).alias("a0"), (F.sum("sb").over(over) - F.col("sb")).alias("b0"), F.sum("sa").over(Window.partitionBy()).alias("na"), F.sum("sb").over(Window.partitionBy()).alias("nb"))
    w = Window.partitionBy("_p").orderBy("x")
    run = placed.withColumn("ra", F.sum("a").over(w)).withColumn("rb", F.sum("b").over(w)).join(F.broadcast(starts), "_p")
    return run.agg(F.max(F.abs((F.col("ra") + F.col("a0")) / F.col("na") - (F.col("rb") + F.col("b0")) / F.col("nb"))).alias("ks"))


def chi_square(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(chi2, degrees, new_categories, new_rows): how the categories of the current data deviate from the reference's proportions. A category
    that the reference lacks has no proportion to compare with; such categories and their rows are counted by themselves."""
    part = lambda d, n: d.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n))
    every = part(reference, "r").join(part(current, "c"), column, "outer").fillna(0, ["r", "c"])
    both = every.withColumn("new", F.col("r") == 0)
    counts = every.filter("r = 0").agg(F.count("*").alias("new_categories"), F.coalesce(F.sum("c"), F.lit(0)).alias("new_rows"))
    both = both.filter("not new").withColumn("e", F.col("r") * F.sum("c").over(Window.partitionBy()) / F.sum("r").over(Window.partitionBy()))
    score = both.agg(F.sum((F.col("c") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("degrees"))
    return score.join(F.broadcast(counts), how="cross")  # one row each


def detect_drift(reference: DataFrame, current: DataFrame, column: str, method: str = "ks", threshold: float = 0.1) -> DataFrame:
    """(column, method, score, drift)."""
    score = {"ks": lambda: ks(reference, current, column).select(F.col("ks").alias("score")), "psi": lambda: psi(reference, current, column).select(F.col("psi").alias("score"))}[method]()
    return score.select(F.lit(column).alias("column"), F.lit(method).alias("method"), "score", (F.col("score") > threshold).alias("drift"))


def balance(df: DataFrame, key: str) -> DataFrame:
    """(shards, rows, min_rows, max_rows, avg_rows, imbalance) of the row counts by key; imbalance is (max - min) / max."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("shards"), F.sum("n").alias("rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"),
        ((F.max("n") - F.min("n")) / F.max("n")).alias("imbalance"),
    )


def distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per row, a struct of statistics for each numeric scalar or array column."""
    from millrace.functions import arrays as A

    out = {}
    for f in df.schema:
        if columns and f.name not in columns:
            continue
        if isinstance(f.dataType, T.NumericType):
            x = F.col(f.name).cast("double")
            out[f.name] = F.struct(x.alias("mean"), F.lit(0.0).alias("std"), x.alias("min"), x.alias("max"), x.alias("median"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            out[f.name] = A.stats(F.col(f.name))
    return df.withColumn("distribution", F.struct(*[c.alias(k) for k, c in out.items()])) if out else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
