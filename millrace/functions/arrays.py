"""Array expressions: statistics, normalising, outliers, padding, masks, vector distances; resampling as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of a struct of `values`, each computed once a row; inside a lambda an outer expression is computed again for each element."""
    bound = F.array(F.struct(*[c.alias(k) for k, c in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def std(a: Column, ddof: int = 0) -> Column:
    n = F.size(a) - ddof
    squares = let({"a": a, "m": mean(a)}, lambda t: F.aggregate(t["a"], F.lit(0.0), lambda x, y: x + (y.cast("double") - t["m"]) * (y.cast("double") - t["m"])))
    return F.when(n > 0, F.sqrt(squares / n))


def median(a: Column) -> Column:
    n = F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, let({"s": F.array_sort(a)}, lambda t: (F.get(t["s"], lo).cast("double") + F.get(t["s"], hi).cast("double")) / 2))


def stats(a: Column) -> Column:
    """Mean, population deviation, least, greatest and median of an array."""
    return F.struct(mean(a).alias("mean"), std(a).alias("std"), F.array_min(a).alias("min"), F.array_max(a).alias("max"), median(a).alias("median"))


def normalize(a: Column, method: str = "zscore") -> Column:
    """zscore, minmax or l2."""
    if method == "zscore":
        return let({"a": a, "m": mean(a), "s": std(a)}, lambda t: F.transform(t["a"], lambda x: (x - t["m"]) / (t["s"] + EPS)))
    if method == "minmax":
        return let({"a": a, "lo": F.array_min(a), "hi": F.array_max(a)}, lambda t: F.transform(t["a"], lambda x: (x - t["lo"]) / (t["hi"] - t["lo"] + EPS)))
    if method == "l2":
        return let({"a": a, "n": norm(a)}, lambda t: F.transform(t["a"], lambda x: x / (t["n"] + EPS)))
    raise ValueError(f"unknown method {method}")


def remove_outliers(a: Column, threshold: float = 3.0) -> Column:
    return let({"a": a, "m": mean(a), "s": std(a)}, lambda t: F.filter(t["a"], lambda x: F.abs(x - t["m"]) / (t["s"] + EPS) < threshold))


def decimate(a: Column, target_rate: int) -> Column:
    """Every size // target_rate-th value of arrays longer than the rate."""
    step = F.greatest(F.floor(F.size(a) / target_rate), F.lit(1))
    return F.when(F.size(a) > target_rate, F.filter(a, lambda x, i: i % step == 0)).otherwise(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda x, y: x + y))


def fit_length(a: Column, target: int | Column, truncate: str = "end", pad: str = "zero") -> Column:
    """Exactly `target` values: longer arrays lose their end, start or both sides alike; shorter ones are padded by 0 or their last value."""
    n = F.size(a)
    t = F.lit(target) if isinstance(target, int) else target
    start = {"end": F.lit(1), "start": n - t + 1, "middle": F.floor((n - t) / 2).cast("int") + 1}[truncate]
    value = F.coalesce(F.get(a, n - 1), F.lit(0)) if pad == "repeat" else F.lit(0)
    padding = F.array_repeat(value, F.greatest(t - n, F.lit(0)))
    return F.when(n >= t, F.slice(a, F.greatest(start, F.lit(1)), t)).otherwise(F.concat(a, padding))


def length_mask(a: Column, target: int) -> Column:
    """1 for real values, 0 for padding."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(1), F.lit(target)), lambda i: F.when(i <= n, 1).otherwise(0))


def attention_mask(n: Column, causal: bool = True) -> Column:
    """n x n mask: lower triangle of ones, or all ones. Empty for n < 1."""
    i = F.sequence(F.lit(0), n - 1)
    full = F.transform(i, lambda r: F.transform(i, lambda c: F.when(c <= r, 1).otherwise(0) if causal else F.lit(1)))
    return F.when(n > 0, full).otherwise(F.array().cast("array<array<int>>"))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline with extrapolation; linear or quadratic for fewer than four points."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n > 1 else np.full(len(at), y[0])
    h = np.diff(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    slope = np.diff(y) / h
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d = at - x[k]
    return y[k] + d * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + d**2 * m[k] / 2 + d**3 * (m[k + 1] - m[k]) / (6 * h[k])


def resampled(x: np.ndarray, y: np.ndarray, rate: float, method: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """int(span * rate) + 1 even points over the span of `x` and the values there."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    at = np.linspace(x[0], x[-1], int((x[-1] - x[0]) * rate + 1e-9) + 1)
    if method == "linear":
        return at, np.interp(at, x, y)
    if method == "nearest":
        return at, y[np.clip(np.searchsorted(x, at), 0, len(x) - 1)]
    if method == "cubic":
        first = np.r_[True, np.diff(x) > 0]
        return at, spline(x[first], y[first], at)
    raise ValueError(f"unknown method {method}")


def resample(times: Column, values: Column, rate: float, method: str = "linear") -> Column:
    """struct(timestamps, values) of a series resampled to `rate` points a second; null where there is no point."""

    def run(t: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = [resampled(a, b, rate, method) if a is not None and len(a) else (None, None) for a, b in zip(t, v)]
        return pd.DataFrame(out, columns=["timestamps", "values"])

    return F.pandas_udf(run, "timestamps array<double>, values array<double>")(times, values)
