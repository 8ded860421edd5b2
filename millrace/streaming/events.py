"""Event-time operators: tumbling, sliding and session windows, deduplication within a watermark, running state per key, file pickup.

All take a batch or a streaming DataFrame; on a stream the watermark bounds how late a row may come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def windowed(df: DataFrame, time: str, length: str, slide: str | None = None, keys: list[str] | None = None, late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """(window_start, window_end, keys, aggregates) of tumbling windows, or with `slide` of sliding ones."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = _marked(df, time, late).groupBy(w.alias("w"), *(keys or [])).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(keys or []), *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Windows that end when a key is quiet for `gap`."""
    out = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """One row a key; on a stream within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, value: str, timeout_ms: int | None = None) -> DataFrame:
    """(key, n, total) after each micro-batch: state that is kept per key and, with `timeout_ms`, forgotten after so long without rows.

    Needs a stream. With a timeout the stream runs batches without end to look for timed-out keys, also when triggered once.
    """
    kind = df.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows[value].sum())
        state.update((n, total))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def stream_files(spark: SparkSession, path: str, schema: Any, format: str = "parquet", per_trigger: int = 100, **options: Any) -> DataFrame:
    """Files below `path` as a stream; with a checkpoint location each is read once."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).options(**options).load(path)


def process_new_files(spark: SparkSession, path: str, schema: Any, transform: Any, output: str, checkpoint: str, format: str = "parquet") -> int:
    """Transform all files that weren't processed yet and append the result; returns the number of rows that the scan gave (filters that reach it count)."""
    stream = transform(stream_files(spark, path, schema, format))
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a bounded stream to its end and give the result as a table in memory; for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    q.awaitTermination()
    return df.sparkSession.table(name)
