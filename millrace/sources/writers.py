"""Writing: native Spark formats, numpy, TFRecord and image files, partitioned output, databases, custom writers."""

from __future__ import annotations

import os
import posixpath
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Writer = Callable[..., None]
MAX_ROWS_PER_FILE = 1_000_000
NATIVE = ("parquet", "json", "csv", "orc", "text", "avro", "xml")
#: Formats whose connector must be on the class path.
CONNECTORS = {"iceberg": "iceberg", "delta": "delta", "bigquery": "bigquery", "clickhouse": "clickhouse", "mongo": "mongodb", "snowflake": "snowflake", "lance": "lance", "sql": "jdbc", "jdbc": "jdbc"}
SUFFIXES = {"parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "txt": "text", "npy": "numpy", "npz": "numpy", "tfrecord": "tfrecords", "tfrecords": "tfrecords", "png": "images", "jpg": "images"}
CUSTOM: dict[str, Writer] = {}
_CUSTOM_SUFFIXES: dict[str, str] = {}


def detect_writer(path: str, format: str | None = None) -> str:
    """The given format, else a telling folder, else the suffix, else parquet."""
    if format:
        return {"jsonl": "json", "image": "images", "tfrecord": "tfrecords", "npy": "numpy"}.get(format, format)
    name = posixpath.basename(path.rstrip("/")).lower()
    suffix = name.rpartition(".")[2] if "." in name else ""
    if suffix in _CUSTOM_SUFFIXES:
        return _CUSTOM_SUFFIXES[suffix]
    folder = [p for p in path.lower().split("/") if p in ("parquet", "json", "csv", "images")]
    return SUFFIXES.get(suffix) or (folder[-1] if folder else "parquet")


def get_writer(format: str) -> Writer:
    own = {"numpy": to_numpy, "tfrecords": to_tfrecords, "images": to_images}
    if format in CUSTOM:
        return CUSTOM[format]
    if format in own:
        return own[format]
    if format in NATIVE or format in CONNECTORS:
        return lambda df, path, **options: _native(df, path, format, **options)
    raise ValueError(f"unknown format {format}")


def list_formats() -> dict[str, list[str]]:
    return {"native": sorted([*NATIVE, "numpy", "tfrecords", "images"]), "connectors": sorted(CONNECTORS), "custom": sorted(CUSTOM)}


def register_custom_writer(extension: str, writer: Writer, format_name: str | None = None) -> None:
    """writer(df, path, **options) for paths with this suffix."""
    name = format_name or extension.lstrip(".")
    CUSTOM[name] = writer
    _CUSTOM_SUFFIXES[extension.lstrip(".").lower()] = name


def write(df: DataFrame, path: str, format: str | None = None, **options: Any) -> None:
    get_writer(detect_writer(path, format))(df, path, **options)


def _native(df: DataFrame, path: str, format: str, mode: str = "overwrite", partition_by: list[str] | None = None, **options: Any) -> None:
    if format == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        df = df.withColumns({c: F.to_json(c) for c in nested})
        options = {"header": True} | options
    out = df.write.mode(mode).format(CONNECTORS.get(format, format)).options(**options)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.save(path) if format not in ("sql", "jdbc") else out.save()


def write_output(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = MAX_ROWS_PER_FILE, compression: str = "snappy") -> None:
    """The pipeline's output: compressed parquet of bounded files, by partition folders; a missing key is looked for in metadata, else 'unknown'."""
    from millrace.functions.records import extract_field

    keys = partition_by or []
    out = df.withColumns({c: F.coalesce(extract_field(df, c, nested=[["metadata"]]).cast("string"), F.lit("unknown")) for c in keys})
    writer = out.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_sql(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options: Any) -> None:
    """All rows over JDBC (no rows are dropped). sqlite:///file goes through Python's own driver, on the driver, a thousand rows at a time: such a
    file has one writer."""
    if url.startswith("sqlite"):
        import sqlite3

        quoted = lambda name: '"' + name.replace('"', '""') + '"'
        kind = lambda t: "INTEGER" if isinstance(t, (T.IntegralType, T.BooleanType)) else "REAL" if isinstance(t, T.FractionalType) else "BLOB" if isinstance(t, T.BinaryType) else "TEXT"
        plain = {c.name for c in df.schema if isinstance(c.dataType, (T.NumericType, T.BooleanType, T.BinaryType, T.StringType)) and not isinstance(c.dataType, T.DecimalType)}
        out = df.withColumns({c.name: F.col(c.name).cast("double") if isinstance(c.dataType, T.DecimalType) else F.to_json(c.name) if isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c.name).cast("string") for c in df.schema if c.name not in plain})
        with sqlite3.connect(url.split("///", 1)[-1]) as db:
            if mode == "overwrite":
                db.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(c.name)} {kind(c.dataType)}' for c in df.schema)})")
            insert = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(df.columns))})"
            rows = (tuple(r) for r in out.toLocalIterator(prefetchPartitions=True))
            while part := list(islice(rows, 1000)):
                db.executemany(insert, part)
        return
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def _files(df: DataFrame, path: str, make: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[str, bytes]]]) -> None:
    """Each task writes its files under a temporary name and moves them, so a repeated task leaves one whole file. `path` must be a folder all
    executors share: a mounted one, or what pyarrow has a file system for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))
        system.create_dir(root, recursive=True)
        n = 0
        for name, data in make(batches):
            part = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.part"
            with system.open_output_stream(part) as f:
                f.write(data)
            system.move(part, f"{root}/{name}")
            n += 1
        yield pd.DataFrame({"n": [n]})

    df.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def to_numpy(df: DataFrame, path: str, column: str | None = None) -> None:
    """One npy file a partition: of `column`, or of all columns as a structured array."""
    import io

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        rows = [b for b in batches if len(b)]
        if rows:
            table = pd.concat(rows)
            a = np.array(table[column].tolist()) if column else table.to_records(index=False)
            if a.dtype.hasobject:
                a = np.array([tuple(str(v) if isinstance(v, (str, type(None))) else v for v in r) for r in a], dtype=[(n, "U" + str(max(1, table[n].astype(str).str.len().max())) if table[n].dtype == object else table[n].dtype) for n in table.columns])
            out = io.BytesIO()
            np.save(out, a, allow_pickle=False)
            yield f"part-{TaskContext.get().partitionId():05d}.npy", out.getvalue()

    _files(df, path, make)


def to_images(df: DataFrame, path: str, column: str = "content", name: str | None = None, suffix: str = "png") -> None:
    """One file a row from encoded image bytes, named by `name` or the row's place."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        k = 0
        for rows in batches:
            for r in rows.to_dict("records"):
                own = os.path.basename(str(r[name])) if name else f"{TaskContext.get().partitionId():05d}-{k:07d}"
                k += 1
                yield f"{own}.{suffix}", bytes(r[column])

    _files(df, path, make)


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


def masked_crc(data: bytes) -> int:
    """CRC-32C, rotated and offset as TFRecord files want it."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(k: int, data: bytes) -> bytes:
    return _number(k << 3 | 2) + _number(len(data)) + data


def example(row: dict[str, Any]) -> bytes:
    """An Example message: texts and bytes, floats, integers and booleans, and lists of them; nulls are left out."""
    entries = b""
    for name, value in row.items():
        if value is None:
            continue
        values = list(value) if isinstance(value, (list, tuple, np.ndarray)) else [value]
        if all(isinstance(v, (str, bytes, bytearray)) for v in values):
            feature = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        elif all(isinstance(v, (int, np.integer, bool, np.bool_)) for v in values):
            feature = _field(3, _field(1, b"".join(_number(int(v)) for v in values)))
        else:
            feature = _field(2, _field(1, struct.pack(f"<{len(values)}f", *[float(v) for v in values])))
        entries += _field(1, _field(1, name.encode()) + _field(2, feature))
    return _field(1, entries)


def to_tfrecords(df: DataFrame, path: str) -> None:
    """One TFRecord file of Example messages a partition."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        out = bytearray()
        for rows in batches:
            for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                body = example(r)
                size = struct.pack("<Q", len(body))
                out += size + struct.pack("<I", masked_crc(size)) + body + struct.pack("<I", masked_crc(body))
        if out:
            yield f"part-{TaskContext.get().partitionId():05d}.tfrecord", bytes(out)

    _files(df, path, make)
