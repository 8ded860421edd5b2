"""Which reader a path gets, and reading it: native Spark formats, and decoders over Spark's binary files."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources import parsers as P

Reader = Callable[..., DataFrame]
# File suffix -> format.
SUFFIXES = {
    "parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "txt": "text", "log": "text", "orc": "orc", "xml": "xml",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
    "mp4": "video", "avi": "video", "mov": "video", "mkv": "video", "webm": "video", "wav": "audio", "mp3": "audio", "flac": "audio", "ogg": "audio",
    "npy": "numpy", "npz": "numpy", "tfrecord": "tfrecord", "tfrecords": "tfrecord", "bin": "binary", "dat": "binary",
    "zip": "archive", "tar": "archive", "tgz": "archive", "gz": "archive", "tar.gz": "archive", "tar.bz2": "archive", "yaml": "yaml", "yml": "yaml", "msgpack": "msgpack", "pb": "protobuf",
    "pcd": "pointcloud", "ply": "pointcloud", "las": "pointcloud", "laz": "pointcloud", "db3": "ros2bag", "bag": "rosbag", "mcap": "mcap", "urdf": "urdf", "sdf": "urdf",
    "pcap": "velodyne", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "h5": "hdf5", "hdf5": "hdf5", "usd": "usd", "usda": "usd", "usdc": "usd",
}
#: A folder of this name tells the format.
SEGMENTS = {"parquet": "parquet", "json": "json", "csv": "csv", "images": "image", "videos": "video"}
#: The data type that the loader tags rows with.
TYPES = {"text": "text", "json": "text", "csv": "sensor", "tsv": "sensor", "parquet": "sensor", "video": "video", "image": "image", "audio": "audio", "numpy": "array", "tfrecord": "array"}
DECODERS: dict[str, tuple[Callable[..., P.Rows], str]] = {
    "archive": (P.archive, P.ARCHIVE), "binary": (P.binary, P.BINARY), "yaml": (P.yaml_config, P.YAML), "calibration": (P.calibration, P.CALIBRATION), "msgpack": (P.msgpack, P.MSGPACK),
    "pointcloud": (P.pointcloud, P.POINTS), "protobuf": (P.protobuf, P.PROTOBUF), "ros2bag": (P.ros2bag, P.MESSAGES), "rosbag": (P.rosbag, P.MESSAGES), "mcap": (P.mcap, P.MESSAGES),
    "urdf": (P.urdf, P.URDF), "velodyne": (P.velodyne, P.PACKETS), "numpy": (P.numpy_arrays, P.NUMPY), "audio": (P.audio, P.AUDIO), "sqlite": (P.sqlite_tables, P.SQLITE), "tfrecord": (P.tfrecord, P.TFRECORD),
}
NATIVE = ("parquet", "csv", "tsv", "json", "text", "orc", "xml", "image", "video", "bytes")
NEEDS = {"hdf5": "h5py", "usd": "pxr"}
CUSTOM: dict[str, Reader] = {}
_CUSTOM_SUFFIXES: dict[str, str] = {}


def detect_format(path: str) -> str:
    """Format of a file name: compound suffix, suffix, then hints in the name (calib*, sensor or imu); 'bytes' if unknown."""
    name = posixpath.basename(path.rstrip("/")).lower()
    for known in (_CUSTOM_SUFFIXES, SUFFIXES):
        parts = name.split(".")
        for k in (2, 1):
            suffix = ".".join(parts[-k:])
            if len(parts) > k and suffix in known:
                found = known[suffix]
                return "calibration" if name.startswith("calib") and found in ("yaml", "json", "xml") else found
    if "sensor" in name or "imu" in name:
        return "csv"
    return "calibration" if name.startswith("calib") else "bytes"


def detect_reader(path: str, format: str | None = None) -> Reader:
    """By the given format, else a telling folder name, else the suffix."""
    if format:
        return get_reader(format)
    found = detect_format(path)
    if found == "bytes":
        hit = [SEGMENTS[p] for p in path.lower().split("/") if p in SEGMENTS]
        found = hit[-1] if hit else found
    return get_reader(found)


def get_reader(format: str) -> Reader:
    f = {"jsonl": "json", "images": "image", "mp4": "video"}.get(format, format)
    if f in CUSTOM:
        return CUSTOM[f]
    if f in NEEDS:
        raise RuntimeError(f"{f} files need the package {NEEDS[f]}, which is not installed")
    if f in DECODERS:
        return lambda spark, paths, **options: decode(spark, paths, *DECODERS[f], **options)
    if f in NATIVE:
        return lambda spark, paths, **options: _native(spark, paths, f, **options)
    raise ValueError(f"unknown format {format}")


def list_formats() -> dict[str, list[str]]:
    return {"native": sorted(NATIVE), "decoded": sorted(DECODERS), "custom": sorted(CUSTOM)}


def register_custom_reader(extension: str, reader: Reader, format_name: str | None = None) -> None:
    """reader(spark, paths, **options) -> DataFrame for files with this suffix."""
    name = format_name or extension.lstrip(".")
    CUSTOM[name] = reader
    _CUSTOM_SUFFIXES[extension.lstrip(".").lower()] = name


def _native(spark: SparkSession, paths: list[str], format: str, **options: Any) -> DataFrame:
    schema = options.pop("schema", None)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if format in ("csv", "tsv"):
        base = {"header": True, "inferSchema": schema is None} | ({"sep": "\t"} if format == "tsv" else {}) | options
        return reader.options(**base).csv(paths)
    if format == "image":
        return spark.read.format("binaryFile").options(**options).load(paths)
    if format in ("video", "bytes"):
        return spark.read.format("binaryFile").options(**options).load(paths).select("path", F.col("content").alias("bytes"), "length", "modificationTime")
    if format == "text":
        return reader.text(paths).withColumnRenamed("value", "text")
    return reader.format(format).load(paths)


def content_of(path: str) -> bytes:
    """The bytes of a file by its path or address."""
    if path.startswith("file:") or "://" not in path:
        plain = unquote(path.removeprefix("file:")) if path.startswith("file:") else path
        with open("/" + plain.lstrip("/"), "rb") as f:
            return f.read()
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        return f.read()


def decode(spark: SparkSession, paths: list[str], parser: Callable[..., P.Rows], schema: str, on_error: str = "raise", path_glob: str | None = None, **options: Any) -> DataFrame:
    """Rows that `parser` makes of each file, with the file's path. on_error='column' gives a row with the message for a file that fails.

    Files are listed by Spark; a task opens its files one after another where they lie (local or mounted folders, or what pyarrow
    has a file system for), so it holds one at a time, and a file may be larger than a value of a column can be.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path_glob:
        files = files.option("pathGlobFilter", path_glob)
    full = f"path string, {schema}, read_error string"
    wanted = to_arrow_schema(T._parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                try:
                    for row in parser(content_of(path), path, **options):
                        held.append({"path": path, **row})
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=wanted)
                            held = []
                except Exception as e:
                    if on_error == "raise":
                        raise
                    held.append({"path": path, "read_error": f"{type(e).__name__}: {e}"})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=wanted)

    return files.load(paths).select("path").mapInArrow(run, full)


def read_paths(spark: SparkSession, paths: str | list[str], format: str | None = None, skip_errors: bool = False, **options: Any) -> DataFrame:
    """Read paths, each by its reader, and unite them by column name (missing columns are null). Fails if nothing can be read.

    Without a forced format a path that its reader refuses is tried as parquet, json, csv and bytes. With `skip_errors` a
    path that can't be read at all is left out.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if not listed:
        raise ValueError("no paths given")
    found, last = [], None
    for path in listed:
        tries = [detect_reader(path, format)] if format else [detect_reader(path), *(get_reader(f) for f in ("parquet", "json", "csv", "bytes"))]
        for reader in tries:
            try:
                found.append(reader(spark, [path], **options))
                break
            except Exception as e:
                last = e
        else:
            if not skip_errors:
                raise last
    if not found:
        raise last or ValueError("nothing could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def load(spark: SparkSession, paths: str | list[str], flags: bool = True, **options: Any) -> DataFrame:
    """Read with tags: `format`, `data_type`, and with `flags` the corruption columns."""
    from millrace.operators.validation import corruption

    listed = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for path in listed:
        kind = options.get("format") or detect_format(path)
        df = read_paths(spark, path, **options)
        tags = {c: F.lit(v) for c, v in (("format", kind), ("data_type", TYPES.get(kind, "binary"))) if c not in df.columns}
        parts.append(df.withColumns(tags))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return corruption(out, checksum=False) if flags else out


def read_sql(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: Any) -> DataFrame:
    """A query or table over JDBC, in parallel by ranges of a numeric `column` of the table; the driver's jar must be on the class path.

    sqlite:///file reads through Python's own driver, on the executors, in `partitions` parts; the file must lie in a folder they share.
    """
    if url.startswith("sqlite"):
        return _read_sqlite(spark, url.split("///", 1)[-1], query or f'SELECT * FROM "{table}"', partitions)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query and not column:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table or f"({query}) q")
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def _read_sqlite(spark: SparkSession, path: str, query: str, partitions: int) -> DataFrame:
    """Each task takes every `partitions`-th row of the query, a thousand at a time; the driver sees a hundred rows, for the types."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        first = pd.read_sql_query(f"SELECT * FROM ({query}) LIMIT 100", db)
    # without any row there are no types to see
    schema = spark.createDataFrame(first).schema if len(first) else T.StructType([T.StructField(c, T.StringType()) for c in first.columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part in rows["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as own:
                    numbered = f"SELECT *, row_number() OVER () AS _row FROM ({query})"
                    for got in pd.read_sql_query(f"SELECT * FROM ({numbered}) WHERE _row % {partitions} = {part}", own, chunksize=1000):
                        yield got.drop(columns="_row").astype(object).where(got.drop(columns="_row").notna(), None)

    return spark.range(partitions).repartition(partitions, "id").mapInPandas(run, schema)


def read_protobuf(spark: SparkSession, paths: str | list[str], descriptor: str, message: str) -> DataFrame:
    """Whole files decoded as one message by a descriptor file."""
    from pyspark.sql.protobuf.functions import from_protobuf

    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", from_protobuf("content", message, descriptor).alias("message"))
