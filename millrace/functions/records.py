"""What a record is: its data type, format, modalities, and where a field is found.

A field is present in a row if the column exists and isn't null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
DATA_TYPES = ("video", "text", "sensor", "binary", "unknown")
FORMAT_TYPES = {"video": ("video", "cosmos_dreams"), "text": ("text", "json", "jsonl"), "sensor": ("sensor", "rosbag", "mcap"), "binary": ("binary",)}
FORMAT_OF_TYPE = {"video": "video", "text": "text", "sensor": "sensor", "binary": "binary"}


def present(df: DataFrame, *names: str) -> Column:
    """Whether any of the columns exists and isn't null."""
    return reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names if n in df.columns], F.lit(False))


def _at(schema: T.StructType, path: list[str]) -> bool:
    for i, name in enumerate(path):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def extract_field(df: DataFrame, name: str, default: object = None, nested: list[list[str]] | None = None) -> Column:
    """Top level, then the nested paths, then a dotted path, then inside sensor_data and metadata."""
    if "." in name and name not in df.columns:
        path = name.split(".")
        return F.coalesce(F.col(name), F.lit(default)) if _at(df.schema, path) else F.lit(default)
    paths = [[name], *([*p, name] for p in nested or []), ["sensor_data", name], ["metadata", name]]
    found = [F.col(".".join(p)) for p in paths if _at(df.schema, p)]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def extract_nested_field(df: DataFrame, path: list[str], default: object = None) -> Column:
    return F.coalesce(F.col(".".join(path)), F.lit(default)) if _at(df.schema, path) else F.lit(default)


def has_field(df: DataFrame, name: str) -> Column:
    return present(df, name)


def data_type(df: DataFrame) -> Column:
    """The declared type, else by format, else by which payload is present."""
    out = F.lit(None).cast("string")
    if "data_type" in df.columns:
        declared = F.lower(F.col("data_type"))
        out = F.when(declared.isin(*DATA_TYPES), declared)
    by_format = F.lit(None).cast("string")
    if "format" in df.columns:
        f = F.lower(F.col("format"))
        by_format = F.coalesce(*[F.when(f.isin(*names), F.lit(kind)) for kind, names in FORMAT_TYPES.items()])
    by_payload = (
        F.when(present(df, "frames", "video"), "video").when(present(df, "text", "content"), "text")
        .when(present(df, "sensor_data", "observations", "actions"), "sensor").otherwise("unknown")
    )
    return F.coalesce(out, by_format, by_payload)


def record_format(df: DataFrame) -> Column:
    kind = data_type(df)
    by_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FORMAT_OF_TYPE.items()], F.lit("unknown"))
    return F.coalesce(F.lower(F.col("format")), by_type) if "format" in df.columns else by_type


def modalities(df: DataFrame) -> Column:
    """Which of video, sensor and text a record has, in that order."""
    return F.array_compact(F.array(
        F.when(present(df, "frames", "video"), F.lit("video")),
        F.when(present(df, "sensor_data", "observations", "actions"), F.lit("sensor")),
        F.when(present(df, "text", "content"), F.lit("text")),
    ))


def extract_text(df: DataFrame) -> Column:
    """`text`, or `content` where it is null or empty."""
    parts = ([F.nullif(F.col("text"), F.lit(""))] if "text" in df.columns else []) + ([F.col("content")] if "content" in df.columns else [])
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def extract_sensor_data(df: DataFrame) -> Column:
    if "sensor_data" in df.columns:
        return F.col("sensor_data")
    parts = [F.col(c) for c in ("observations", "actions") if c in df.columns]
    return F.struct(*parts) if parts else F.lit(None)


def data_type_flags(df: DataFrame, payload: str | None = None, format_value: str | None = None) -> DataFrame:
    """Tag rows with a format and a data type."""
    tags = {k: F.lit(v) for k, v in (("format", format_value), ("data_type", payload)) if v}
    return df.withColumns(tags)
