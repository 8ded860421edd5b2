"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are handled as heavy, each sent with its number of salts to all tasks (a few MB at most). By counting, a key
#: outside the TOP heaviest holds less than a hundred-thousandth of the rows.
TOP = 100_000
#: Rows of one key that one task may take.
CHUNK = 200_000


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n", chunk: int = CHUNK, top: int = TOP) -> DataFrame:
    """The heaviest keys with the number of salts each is split into; never more than `top` rows."""
    return (
        counts.filter(F.col(n) > chunk)
        .orderBy(F.col(n).desc())
        .limit(top)
        .select(*keys, F.ceil(F.col(n) / chunk).cast("int").alias("_salts"))
    )


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, salt_by: Column, n: str = "n", chunk: int = CHUNK, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Equi-join of `big` (any number of rows a key) with `small` (few rows a key), inner or left.

    `counts` holds the number of rows of each key of `big`. Heavy keys of `big` are salted by `salt_by` and the rows of
    `small` with such a key are repeated once a salt. Null keys join nothing. `rows`: how many `big` has, if known; no key
    of a table of at most `chunk` rows is heavy, so nothing is salted then.
    """
    if rows is not None and rows <= chunk:
        return big.join(small, keys, how)
    heavy = F.broadcast(heavy_keys(counts, keys, n, chunk))
    left = big.join(heavy, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(salt_by), F.col("_salts")).cast("int")).otherwise(0)
    ).drop("_salts")
    right = small.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
