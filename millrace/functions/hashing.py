"""Stable hashes for shards, splits and reproducible choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_mod(key: Column, n: int) -> Column:
    """int(md5(key), 16) % n: the hex digest is folded in 16-bit steps, so 64-bit numbers are enough."""
    digest = F.md5(key.cast("string").cast("binary"))
    step = lambda acc, i: (acc * 65536 + F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long")) % n
    return reduce(step, range(8), F.lit(0).cast("long"))


def row_key(df: DataFrame) -> Column:
    """The same for equal rows in every run."""
    return F.xxhash64(F.to_json(F.struct(*df.columns))).cast("string")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def checksum(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
