"""Validators and scores of records. Each adds columns; `reject` keeps only valid rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.records import data_type, extract_sensor_data, extract_text, modalities, present

# Fixed values.
REQUIRED = {"video": ("frames", "format"), "sensor": ("sensor_data", "format"), "text": ("text", "format")}
TOLERANCE = 1e-3


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def reject(df: DataFrame, on: bool, flag: str = "is_valid") -> DataFrame:
    return df.filter(F.col(flag)) if on else df


def completeness(df: DataFrame, required: Mapping[str, tuple[str, ...]] = REQUIRED, allow_partial: bool = True, fill: Mapping[str, object] | None = None) -> DataFrame:
    """missing_fields, completeness_score and is_valid by the fields that the record's data type requires.

    `fill` gives values for missing fields (of columns that exist); filled fields don't count as missing.
    """
    out = df
    for c, v in (fill or {}).items():
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    kind = data_type(out)
    gone = _strings(*[F.when((kind == k) & ~present(out, f), F.lit(f)) for k, fields in required.items() for f in fields])
    need = F.coalesce(*[F.when(kind == k, F.lit(len(fields))) for k, fields in required.items()], F.lit(0))
    out = out.withColumn("missing_fields", gone).withColumn("completeness_score", 1 - F.size("missing_fields") / F.greatest(need, F.lit(1)))
    return reject(out.withColumn("is_valid", F.size("missing_fields") == 0), not allow_partial)


def cross_modal(df: DataFrame, required: tuple[str, ...] = (), max_gap: float = 0.1, rejecting: bool = False) -> DataFrame:
    """cross_modal_violations, detected_modalities, num_modalities, is_valid. A time of 0 is a time."""
    found = modalities(df)
    times = {m: F.coalesce(*[F.col(c).cast("double") for c in (f"{m}_timestamp", "timestamp") if c in df.columns], F.lit(None)) for m in ("video", "sensor", "text")}
    known = F.array_compact(F.array(*[F.when(F.array_contains(found, m), t) for m, t in times.items()]))
    gap = F.array_max(known) - F.array_min(known)
    sensor = extract_sensor_data(df)
    issues = [
        *[F.when(~F.array_contains(found, m), F.lit(f"missing:{m}")) for m in required],
        F.when(F.array_contains(found, "sensor") & sensor.isNull(), F.lit("no_sensor_data")),
        F.when(F.array_contains(found, "text") & (F.coalesce(extract_text(df), F.lit("")) == ""), F.lit("no_text")),
        F.when((F.size(found) > 1) & (gap > max_gap), F.lit("temporal_misalignment")),
        F.when(present(df, "temporal_alignment_error"), F.lit("temporal_alignment_error")),
        F.when(present(df, "temporal_consistency_warning"), F.lit("temporal_consistency_warning")),
    ]
    out = df.withColumns({"cross_modal_violations": _strings(*issues), "detected_modalities": found, "num_modalities": F.size(found)})
    return reject(out.withColumn("is_valid", F.size("cross_modal_violations") == 0), rejecting)


def _entries(values: Column, kind: T.DataType) -> Column:
    """Array of (name, value) of joint readings given as a map, a struct or an array (named joint_i)."""
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(values), lambda e: F.struct(e.key.alias("name"), e.value.cast("double").alias("value")))
    if isinstance(kind, T.StructType):
        return F.array(*[F.struct(F.lit(n).alias("name"), values[n].cast("double").alias("value")) for n in kind.names])
    return F.transform(values, lambda v, i: F.struct(F.concat(F.lit("joint_"), i.cast("string")).alias("name"), v.cast("double").alias("value")))


def limit_violations(df: DataFrame, column: str, low: Mapping[str, float] | float | None, high: Mapping[str, float] | float, what: str, absolute: bool = False) -> Column:
    """Names of joints beyond their limits, as '<what>:<joint>'; `column` may be nested. Limits by joint, or one for all."""
    kind: T.DataType = df.schema
    for part in column.split("."):
        kind = kind[part].dataType
    limits = lambda spec: (lambda e: F.lit(spec) if isinstance(spec, (int, float)) else F.try_element_at(F.create_map(*[F.lit(x) for kv in spec.items() for x in kv]), e["name"]))
    top = limits(high)
    bottom = limits(low) if low is not None else None

    def bad(e: Column) -> Column:
        v = F.abs(e.value) if absolute else e.value
        over = v > top(e) + TOLERANCE
        return F.coalesce(over | (e.value < bottom(e) - TOLERANCE) if bottom and not absolute else over, F.lit(False))

    found = F.transform(F.filter(_entries(F.col(column), kind), bad), lambda e: F.concat(F.lit(f"{what}:"), e["name"]))
    return F.coalesce(found, F.array().cast("array<string>"))


def physics(
    df: DataFrame, position: tuple | None = None, velocity: Mapping[str, float] | float | None = None, acceleration: Mapping[str, float] | float | None = None,
    root: str = "sensor_data", dynamics: bool = True, rejecting: bool = True,
) -> DataFrame:
    """violations, num_violations, physics_validated, is_valid of sensor records; other records pass.

    position is (low, high). Limits hold with a tolerance of 1e-3. A missing sensor_data is a violation of its own.
    """
    have = set(df.schema[root].dataType.names) if root in df.columns and isinstance(df.schema[root].dataType, T.StructType) else set()
    parts = []
    if position and "joint_positions" in have:
        parts.append(limit_violations(df, f"{root}.joint_positions", position[0], position[1], "position"))
    if velocity is not None and "joint_velocities" in have:
        parts.append(limit_violations(df, f"{root}.joint_velocities", None, velocity, "velocity", absolute=True))
    if dynamics and {"joint_positions", "joint_velocities"} <= have:
        a, b = F.col(f"{root}.joint_positions"), F.col(f"{root}.joint_velocities")
        parts.append(F.when(F.size(a) != F.size(b), F.array(F.lit("dynamics:length"))).otherwise(F.array().cast("array<string>")))
    if acceleration is not None and "joint_accelerations" in have:
        parts.append(limit_violations(df, f"{root}.joint_accelerations", None, acceleration, "acceleration", absolute=True))
    if root in df.columns:
        parts.append(F.when(F.col(root).isNull(), F.array(F.lit("no_sensor_data"))).otherwise(F.array().cast("array<string>")))
    sensor = data_type(df) == "sensor"
    none = F.array().cast("array<string>")
    found = F.when(sensor, F.concat(*parts) if parts else none).otherwise(none)
    out = df.withColumn("violations", found).withColumn("num_violations", F.size("violations")).withColumn("physics_validated", sensor)
    return reject(out.withColumn("is_valid", F.col("num_violations") == 0), rejecting)


def schema(df: DataFrame, expected: Mapping[str, object], strict: bool = True, rejecting: bool = False) -> DataFrame:
    """schema_errors and schema_valid. expected: column -> type name, or (type name, least, greatest).

    A column is missing (or null in a row that needs it), of another type, out of range, or with `strict` unexpected.
    """
    kinds = dict(df.dtypes)
    same = {"int": ("int", "bigint", "smallint", "tinyint"), "float": ("double", "float", "int", "bigint"), "str": ("string",), "bool": ("boolean",), "list": ("array",), "dict": ("map", "struct")}
    errors = []
    for c, spec in expected.items():
        kind, low, high = spec if isinstance(spec, tuple) else (spec, None, None)
        if c not in kinds:
            errors.append(F.lit(f"missing:{c}"))
            continue
        base = kinds[c].split("<")[0]
        if base not in same.get(kind, (kind,)):
            errors.append(F.when(F.col(c).isNotNull(), F.lit(f"type:{c}")))
        errors.append(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")))
        if low is not None or high is not None:
            out = (F.col(c) < F.lit(low) if low is not None else F.lit(False)) | (F.col(c) > F.lit(high) if high is not None else F.lit(False))
            errors.append(F.when(out, F.lit(f"range:{c}")))
    if strict:
        errors += [F.lit(f"unexpected:{c}") for c in df.columns if c not in expected]
    out = df.withColumn("schema_errors", _strings(*errors)).withColumn("schema_valid", F.size("schema_errors") == 0)
    return reject(out, rejecting, "schema_valid")


def infer_schema(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def corruption(df: DataFrame, checksum: bool = True) -> DataFrame:
    """corruption_flags, is_corrupted and data_checksum (SHA-256 of the canonical JSON of all columns)."""
    kind = F.coalesce(*[F.lower(F.col(c)) for c in ("data_type", "format") if c in df.columns], F.lit("unknown"))
    flags = _strings(
        F.when(present(df, "error"), F.lit("error_field_present")),
        F.when(~present(df, "data_type", "format"), F.lit("missing_data_type_or_format")),
        F.when((kind == "video") & ~present(df, "frames", "video", "bytes"), F.lit("video_missing_data")),
        F.when((kind == "sensor") & ~present(df, "sensor_data", "observations"), F.lit("sensor_missing_data")),
        F.when((kind == "text") & ~present(df, "text", "content"), F.lit("text_missing_data")),
    )
    out = df.withColumn("corruption_flags", flags).withColumn("is_corrupted", F.size("corruption_flags") > 0)
    if checksum:
        from millrace.functions.hashing import checksum as digest

        out = out.withColumn("data_checksum", digest(df, df.columns))
    return out


def anomaly(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """anomaly_score in [0, 1] by rules on the columns of the validators, and is_anomaly."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    parts = [F.when(present(df, "error"), 0.5)]
    if "corruption_flags" in df.columns:
        parts.append(F.when(n("corruption_flags") > 0, 0.3))
    if "missing_fields" in df.columns:
        parts.append(0.2 * n("missing_fields"))
    if "quality_score" in df.columns:
        parts.append(F.when(F.col("quality_score") < 0.5, 0.3))
    if "violations" in df.columns:
        parts.append(0.2 * F.least(n("violations"), F.lit(5)) / 5.0)
    parts.append(F.when(present(df, "temporal_alignment_error"), 0.2))
    score = F.least(F.lit(1.0), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    return df.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > threshold)


def quality(df: DataFrame, dimensions: tuple[str, ...] = ("visual", "sensor", "text", "consistency"), threshold: float = 0.5) -> DataFrame:
    """quality_scores (by dimension), quality_score (their mean) and meets_quality_threshold."""
    kind = data_type(df)
    text = F.coalesce(extract_text(df), F.lit(""))
    factor = lambda cond, x: F.when(cond, x).otherwise(1.0)

    def of_text() -> Column:
        n = F.length(text)
        score = F.when(n < 10, 0.3).when(n > 10000, 0.8).otherwise(1.0) * factor(X.has_any(text, X.BOILERPLATE_SHORT), 0.2)
        if "processed" in df.columns:
            score = score * factor(~F.coalesce("processed", F.lit(True)), 0.0)
        return F.when(kind != "text", 1.0).when(n == 0, 0.0).otherwise(score)

    def of_visual() -> Column:
        score = F.lit(1.0)
        if "frames" in df.columns:
            score = score * factor(F.size("frames") == 0, 0.0)
        if "resolution" in df.columns:
            least = F.least(F.get("resolution", F.lit(0)), F.get("resolution", F.lit(1)))
            score = score * F.when(least < 64, 0.5).when(least < 224, 0.8).otherwise(1.0)
        return F.when(kind != "video", 1.0).otherwise(score * factor(present(df, "error"), 0.0))

    def of_sensor() -> Column:
        if "sensor_data" not in df.columns:
            return F.when(kind != "sensor", 1.0).otherwise(0.0)
        t = df.schema["sensor_data"].dataType
        names = set(t.names) if isinstance(t, T.StructType) else set()
        full = F.lit({"observations", "actions"} <= names)
        if {"observations", "actions"} <= names:
            full = F.col("sensor_data.observations").isNotNull() & F.col("sensor_data.actions").isNotNull()
        score = factor(~full, 0.7)
        if "outlier_count" in names:
            whole = F.greatest(F.coalesce(F.col("sensor_data.total_samples") if "total_samples" in names else F.lit(1), F.lit(1)), F.lit(1))
            score = score * factor(F.coalesce(F.col("sensor_data.outlier_count") / whole > 0.1, F.lit(False)), 0.5)
        return F.when(kind != "sensor", 1.0).when(F.col("sensor_data").isNull(), 0.0).otherwise(score)

    def of_consistency() -> Column:
        score = factor(present(df, "temporal_alignment_error"), 0.5) * factor(present(df, "temporal_consistency_warning"), 0.7)
        if "multimodal" in df.columns:
            score = score * factor(F.coalesce("multimodal", F.lit(False)) & (F.size(modalities(df)) < 2), 0.6)
        return score

    known = {"visual": of_visual, "sensor": of_sensor, "text": of_text, "consistency": of_consistency}
    scores = F.struct(*[(known[d]() if d in known else F.lit(0.5)).alias(d) for d in dimensions])
    out = df.withColumn("quality_scores", scores)
    out = out.withColumn("quality_score", sum((F.col(f"quality_scores.{d}") for d in dimensions), F.lit(0.0)) / len(dimensions))
    return out.withColumn("quality_threshold", F.lit(threshold)).withColumn("meets_quality_threshold", F.col("quality_score") >= threshold)


def ground_instructions(df: DataFrame, field: str = "instruction", min_length: int = 5) -> DataFrame:
    """Keep rows with an instruction of `min_length` characters; add its length, format, quality and how well a trajectory fits."""
    from millrace.functions.records import extract_field

    given = [extract_field(df, f).cast("string") for f in dict.fromkeys((field, "instruction", "text", "command", "task_description", "goal"))]
    instruction = F.coalesce(*given, extract_text(df))
    out = df.withColumn("instruction", instruction).filter(F.length("instruction") >= min_length)
    observed, acted = present(df, "observations", "sensor_data"), present(df, "actions")
    alignment = F.when(observed & acted, 0.8).when(observed | acted, 0.5).when(present(df, "trajectory"), 0.2).otherwise(0.0)
    return out.withColumns({
        "instruction_length": F.length("instruction"), "instruction_format": X.instruction_format(F.col("instruction")),
        "has_trajectory": present(df, "trajectory", "observations", "actions", "sensor_data"), "instruction_alignment_score": alignment,
        "instruction_aligned": alignment > 0.5, "instruction_quality_score": X.instruction_quality(F.col("instruction"), min_length),
    })


def video_quality(width: Column, height: Column, frames: Column) -> Column:
    """Mean of a score for the resolution and one for the number of frames."""
    side = F.least(width, height)
    by_size = F.when(side >= 224, 1.0).when(side >= 128, 0.7).otherwise(0.3)
    return (by_size + F.when(frames >= 30, 1.0).when(frames >= 10, 0.7).otherwise(0.3)) / 2
