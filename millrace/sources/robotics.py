"""Folders of trajectories, simulations and generated videos as uniform rows."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.records import data_type, extract_field

# Fixed values.
META = ("episode_id", "robot_id", "task_id", "episode_length", "timestep", "environment", "success")
GROOT_TYPES = ("sensor", "video", "text", "multimodal")
SIDECAR = ("prompt", "model", "resolution", "num_frames", "fps", "seed", "duration")


def read_trajectories(spark: SparkSession, paths: str | list[str], validate: bool = True) -> DataFrame:
    """All parquet, jsonl and json files below the paths, united, in the uniform shape; invalid rows are dropped when validating."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for form, glob in (("parquet", "*.parquet"), ("json", "*.jsonl"), ("json", "*.json")):
        reader = spark.read.format(form).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        try:
            part = reader.load(listed)
            if part.columns:
                parts.append(part)
        except AnalysisException as e:  # no file of that kind; a folder that isn't there is an error
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    if not parts:
        raise FileNotFoundError(f"no trajectories below {listed}")
    df = trajectory_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    return df.filter(F.size("trajectory_errors") == 0).drop("trajectory_errors") if validate else df


def trajectory_rows(df: DataFrame) -> DataFrame:
    """data_type, format, source, groot_metadata and what is there of observations, actions, rewards and sensor_data, with trajectory_errors."""
    meta = F.struct(*[extract_field(df, c, nested=[["groot_metadata"]]).cast("string").alias(c) for c in META])
    kind = F.lower(F.col("data_type")) if "data_type" in df.columns else F.lit("sensor")
    errors: list[Column] = []
    for c in ("episode_id", "robot_id", "task_id"):
        v = extract_field(df, c, nested=[["groot_metadata"]]).cast("string")
        errors.append(F.when(v.isNotNull() & (F.trim(v) == ""), F.lit(f"empty:{c}")))
    errors.append(F.when(~F.coalesce(kind, F.lit("sensor")).isin(*GROOT_TYPES), F.lit("data_type")))
    keep = [c for c in ("observations", "actions", "rewards", "sensor_data") if c in df.columns]
    return df.select(
        F.coalesce(kind, F.lit("sensor")).alias("data_type"), F.lit("groot").alias("format"), F.lit("groot").alias("source"), meta.alias("groot_metadata"), *keep,
        F.array_compact(F.array(*errors)).alias("trajectory_errors"),
    )


def read_simulation(spark: SparkSession, path: str, robot_id: str = "robot") -> DataFrame:
    """*trajectory*.parquet files below the path (else any parquet) as sensor rows."""
    reader = spark.read.option("recursiveFileLookup", "true")
    try:
        df = reader.option("pathGlobFilter", "*trajectory*.parquet").parquet(path)
    except Exception:
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return simulation_rows(df, robot_id)


def simulation_rows(df: DataFrame, robot_id: str = "robot") -> DataFrame:
    data = [c for c in ("observations", "actions", "rewards", "dones", "joint_positions", "joint_velocities") if c in df.columns]
    return df.select(
        F.coalesce(*([F.col("robot_id").cast("string")] if "robot_id" in df.columns else []), F.lit(robot_id)).alias("robot_id"),
        F.lit("sensor").alias("data_type"), F.lit("simulation").alias("format"), F.struct(*data).alias("sensor_data") if data else F.lit(None).alias("sensor_data"),
        *[extract_field(df, c, nested=[["metadata"]]).alias(c) for c in ("episode_id", "task", "environment", "step")],
    )


def observation_space(df: DataFrame, column: str = "observations") -> dict[str, Any]:
    """Type, and for arrays the greatest length, of each observation."""
    kind = df.schema[column].dataType
    names = kind.names if isinstance(kind, T.StructType) else [None]
    path = lambda n: column if n is None else f"{column}.{n}"
    types = {n: (kind if n is None else kind[n].dataType) for n in names}
    sized = [F.max(F.size(path(n))).alias(str(n)) for n in names if isinstance(types[n], T.ArrayType)]
    sizes = df.agg(*sized).first().asDict() if sized else {}
    return {n or column: {"dtype": types[n].simpleString(), "shape": sizes.get(str(n))} for n in names}


def loader_statistics(df: DataFrame) -> dict[str, Any]:
    return {"count": df.count(), "columns": df.columns}


def read_generated_videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files with the fields of the JSON file of the same stem, and a quality score."""
    from millrace.operators.validation import video_quality

    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mp4,avi,mov,mkv,webm}").load(path)
    videos = files.select("path", stem(F.col("path")).alias("stem"), F.col("content").alias("bytes"), "length")
    meta = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    meta = meta.select(stem(F.input_file_name()).alias("_f"), F.col("value").alias("metadata")).select(F.regexp_replace("_f", "^file:/+", "file:/").alias("stem"), "metadata")
    videos = videos.withColumn("stem", F.regexp_replace("stem", "^file:/+", "file:/"))
    out = videos.join(meta, "stem", "left").drop("stem")
    get = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}"), F.get_json_object("metadata", f"$.generation_params.{k}"))
    out = out.withColumns({f"gen_{k}": get(k) for k in SIDECAR})
    size = F.from_json("gen_resolution", "array<int>")
    score = video_quality(F.get(size, F.lit(0)), F.get(size, F.lit(1)), F.col("gen_num_frames").cast("int"))
    return out.withColumns({"data_type": F.lit("video"), "format": F.lit("cosmos_dreams"), "quality_score": F.when(F.col("metadata").isNotNull(), score)})


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, frame, length): images, depth maps, segmentations and annotations of a rendered data set."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    low = F.lower("path")
    kind = F.when(low.endswith(".json"), "annotation").when(low.endswith(".npy"), "depth").when(low.contains("semantic"), "semantic").when(low.rlike(r"\.(png|jpe?g)$"), "image").otherwise("other")
    return files.select("path", kind.alias("kind"), F.regexp_extract("path", r"(\d+)\D*$", 1).alias("frame"), "length")
