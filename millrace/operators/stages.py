"""Pipeline stages: `stage.transform(df) -> df`. Stages of one modality change its rows and pass the others through, or drop them with strict=True."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.functions.hashing import md5_mod, row_key
from millrace.functions.records import data_type, extract_text
from millrace.operators import episodes, statistics, validation
from millrace.operators.order import with_row_index


class Stage:
    """A named step; subclasses define `transform`."""

    name = "stage"

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    process = property(lambda self: self.transform)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


class FunctionStage(Stage):
    """A plain function of a DataFrame as a stage."""

    def __init__(self, func: Callable[[DataFrame], DataFrame], name: str | None = None):
        self.func, self.name = func, name or getattr(func, "__name__", "function")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.func(df)


def stage(func: Callable[..., DataFrame], **options: Any) -> Stage:
    """A stage from an operator and its options."""
    return FunctionStage(lambda df: func(df, **options), func.__name__)


class TextProcessor(Stage):
    """Clean text rows; those that fail the length or boilerplate filter are dropped. Adds processed and text_length."""

    name = "text_processor"

    def __init__(self, min_length: int = X.MIN_LENGTH, max_length: int = X.MAX_LENGTH, remove_boilerplate: bool = True, strict: bool = False):
        self.min_length, self.max_length, self.remove_boilerplate, self.strict = min_length, max_length, remove_boilerplate, strict

    def transform(self, df: DataFrame) -> DataFrame:
        kind = data_type(df)
        raw = extract_text(df)
        out = df.withColumn("_kind", kind).withColumn("_raw", raw).withColumn("_why", X.reject_reason(F.col("_raw"), self.min_length, self.max_length, self.remove_boilerplate))
        is_text = F.col("_kind") == "text"
        out = out.filter((is_text & F.col("_why").isNull()) | (~is_text if not self.strict else F.lit(False)))
        cleaned = X.clean(F.col("_raw"))
        out = out.withColumn("processed", F.when(is_text, True)).withColumn("text_length", F.when(is_text, F.length(cleaned)))
        out = out.withColumn("text", F.when(is_text, cleaned).otherwise(F.col("text") if "text" in df.columns else F.lit(None)))
        return out.drop("_kind", "_raw", "_why")


class SensorProcessor(Stage):
    """Remove outliers, normalise and decimate array columns of sensor rows."""

    name = "sensor_processor"

    def __init__(self, columns: list[str], outlier_threshold: float | None = 3.0, normalize: str | None = "zscore", target_rate: int | None = 100, outliers: str = "zscore", strict: bool = False):
        self.columns, self.threshold, self.normalize, self.rate, self.outliers, self.strict = columns, outlier_threshold, normalize, target_rate, outliers, strict

    def transform(self, df: DataFrame) -> DataFrame:
        sensor = data_type(df) == "sensor"
        out = df.withColumn("_sensor", sensor)
        if self.strict:
            out = out.filter("_sensor")
        for c in self.columns:
            x = F.col(c)
            if self.threshold is not None:
                x = A.remove_outliers(x, self.threshold) if self.outliers == "zscore" else density_outliers(x)
            if self.normalize:
                x = A.normalize(x, self.normalize)
            if self.rate:
                x = A.decimate(x, self.rate)
            out = out.withColumn(c, F.when(F.col("_sensor"), x).otherwise(F.col(c)))
        return out.withColumn("processed", F.when(F.col("_sensor"), True)).drop("_sensor")


def density_outliers(a: Column, eps: float = 0.5, least: int = 5) -> Column:
    """Keep values that a one-dimensional density clustering puts in a cluster."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            if v is None or not len(v):
                out.append(v)
                continue
            x = np.asarray(v, float)
            o = np.argsort(x)
            y = x[o]
            near = np.searchsorted(y, y + eps, side="right") - np.searchsorted(y, y - eps, side="left")
            core = y[near >= least]
            at = np.searchsorted(core, y)
            gap = np.minimum(np.abs(y - core[np.clip(at, 0, len(core) - 1)]), np.abs(y - core[np.clip(at - 1, 0, len(core) - 1)])) if len(core) else np.full(len(y), np.inf)
            keep = np.zeros(len(x), bool)
            keep[o] = gap <= eps
            out.append(x[keep])
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(a)


class IsolationOutliers(Stage):
    """Keep values of an array column that are hard to isolate by random cuts; the `contamination` share with the shortest paths goes."""

    name = "isolation_outliers"

    def __init__(self, column: str, contamination: float = 0.1, trees: int = 50, seed: int = 42):
        self.column, self.contamination, self.trees, self.seed = column, contamination, trees, seed

    def transform(self, df: DataFrame) -> DataFrame:
        contamination, trees, seed = self.contamination, self.trees, self.seed

        def depth(x: np.ndarray) -> np.ndarray:
            rng = np.random.default_rng(seed)
            total = np.zeros(len(x))
            limit = int(np.ceil(np.log2(max(len(x), 2))))
            for _ in range(trees):
                stack = [(np.arange(len(x)), 0)]
                while stack:
                    at, d = stack.pop()
                    lo, hi = x[at].min(), x[at].max()
                    if len(at) < 2 or d >= limit or lo == hi:
                        total[at] += d
                        continue
                    c = rng.uniform(lo, hi)
                    left = x[at] < c
                    stack += [(p, d + 1) for p in (at[left], at[~left]) if len(p)]
            return total

        def run(s: pd.Series) -> pd.Series:
            out = []
            for v in s:
                x = np.asarray(v, float) if v is not None else np.zeros(0)
                drop = int(len(x) * contamination)
                if drop:
                    keep = np.ones(len(x), bool)
                    keep[np.argsort(depth(x), kind="stable")[:drop]] = False
                    x = x[keep]
                out.append(x if v is not None else None)
            return pd.Series(out)

        return df.withColumn(self.column, F.pandas_udf(run, "array<double>")(self.column))


def sampled_frames(frames: np.ndarray, fps: float | None = None, rate: float | None = None, size: tuple[int, int] | None = (224, 224), scale: bool = True) -> np.ndarray:
    """Of frames (n, height, width[, channels]) every max(1, int(fps / rate))-th, resized by area-free nearest pixels, and in [0, 1] with `scale`."""
    out = np.asarray(frames)
    if fps and rate:
        out = out[:: max(1, int(fps / rate))]
    if size and len(out):
        rows = (np.arange(size[0]) * out.shape[1] / size[0]).astype(int)
        columns = (np.arange(size[1]) * out.shape[2] / size[1]).astype(int)
        out = out[:, rows][:, :, columns]
    return out / 255.0 if scale else out


def npy_frames(data: bytes) -> tuple[np.ndarray, float | None]:
    """Frames stored as one npy array; the decoder that needs no codec."""
    import io

    return np.load(io.BytesIO(data), allow_pickle=False), None


class VideoProcessor(Stage):
    """Frames of video rows: decoded by `decoder` (bytes -> frames, or frames and their rate), sampled, resized and scaled, each flattened.

    Without a decoder contents that are npy arrays are read; other codecs need one, and a content that can't be decoded gives null frames and frames_error.
    """

    name = "video_processor"

    def __init__(self, decoder: Callable[[bytes], Any] | None = None, column: str = "content", rate: float | None = None, size: tuple[int, int] | None = (224, 224), scale: bool = True, strict: bool = False):
        self.decoder, self.column, self.rate, self.size, self.scale, self.strict = decoder or npy_frames, column, rate, size, scale, strict

    def transform(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            raise RuntimeError(f"there is no column {self.column} for the decoder")
        decode, rate, size, scale = self.decoder, self.rate, self.size, self.scale
        video = data_type(df) == "video"

        def run(contents: pd.Series) -> pd.DataFrame:
            out = []
            for b in contents:
                if b is None:
                    out.append((None, None, None))
                    continue
                try:
                    got = decode(bytes(b))
                    frames, fps = got if isinstance(got, tuple) else (got, None)
                    made = sampled_frames(frames, fps, rate, size, scale)
                    out.append((made.reshape(len(made), -1).astype(float).tolist(), list(made.shape), None))
                except Exception as e:
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(out, columns=["frames", "shape", "error"])

        made = F.pandas_udf(run, "frames array<array<double>>, shape array<int>, error string")
        out = (df.filter(video) if self.strict else df).withColumn("_v", made(F.when(video, F.col(self.column))))
        return out.withColumns({"frames": F.col("_v.frames"), "frames_shape": F.col("_v.shape"), "frames_error": F.col("_v.error")}).drop("_v")


def text_embeddings(df: DataFrame, text: str = "text", name: str = "embedding", dimension: int = 384) -> DataFrame:
    """A stand-in for a model: a Gaussian unit vector seeded by the text's SHA-256. Equal texts are equal, others nearly orthogonal; null stays null."""
    import hashlib

    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            if t is None:
                out.append(None)
                continue
            v = np.random.default_rng(np.frombuffer(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), np.uint32)).normal(size=dimension)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return pd.Series(out)

    return df.withColumn(name, F.pandas_udf(run, "array<float>")(text))


class QualityFilter(Stage):
    """Rows that pass all predicates (Columns, SQL text, or functions of the DataFrame)."""

    name = "quality_filter"

    def __init__(self, predicates: list[Column | str | Callable[[DataFrame], Column]]):
        self.predicates = predicates

    def transform(self, df: DataFrame) -> DataFrame:
        for p in self.predicates:
            df = df.filter(p(df) if callable(p) and not isinstance(p, Column) else p)
        return df


class DataTransformer(Stage):
    """An optional filter, then a function of rows or batches; `error_field` gets the message of failing rows instead of dropping them."""

    name = "data_transformer"

    def __init__(self, transform_func: Callable[[dict], dict], schema: str | T.StructType | None = None, filter_func: Column | str | None = None, error_field: str | None = None):
        self.func, self.schema, self.filter_func, self.error_field = transform_func, schema, filter_func, error_field

    def transform(self, df: DataFrame) -> DataFrame:
        from millrace.frame import Frame

        if self.filter_func is not None:
            df = df.filter(self.filter_func)
        if self.error_field:
            return process_rows(df, self.func, self.schema or df.schema, self.error_field)
        return Frame(df).map(self.func, self.schema).df


def process_rows(df: DataFrame, func: Callable[[dict], dict], schema: str | T.StructType, error_field: str = "processing_error", keep_on_error: bool = True) -> DataFrame:
    """A row function with an error column: failing rows keep their fields that the schema has, and get the message."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*wanted.fields, T.StructField(error_field, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                try:
                    out.append({**func(row), error_field: None})
                except Exception as e:
                    if keep_on_error:
                        out.append({**{k: v for k, v in row.items() if k in wanted.names}, error_field: f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=full.names)

    return df.mapInPandas(run, full)


class FeatureEngineering(Stage):
    """Add feature_<name> from expressions, or from row callables (errors give null)."""

    name = "feature_engineering"

    def __init__(self, feature_functions: Mapping[str, Column | str | Callable[[dict], Any]], returns: Mapping[str, str] | None = None):
        self.functions, self.returns = feature_functions, returns or {}

    def transform(self, df: DataFrame) -> DataFrame:
        from millrace.frame import Frame

        out = Frame(df)
        for name, fn in self.functions.items():
            out = out.with_column(f"feature_{name}", fn, self.returns.get(name))
        return out.df


class DataAggregator(Stage):
    """One global aggregation; both spellings of the options are accepted."""

    name = "data_aggregator"

    def __init__(self, group_by: list[str] | None = None, aggregations: Mapping[str, str | list[str]] | None = None, groupby_columns: list[str] | None = None, agg_functions: Mapping[str, str | list[str]] | None = None):
        self.keys, self.aggregations = list(group_by or groupby_columns or []), aggregations or agg_functions or {}

    def transform(self, df: DataFrame) -> DataFrame:
        from millrace.frame import Grouped

        return Grouped(df, self.keys).agg(self.aggregations).df


class ColumnAnalytics(Stage):
    """Whole-table statistics and z-scores on each row."""

    name = "column_analytics"

    def __init__(self, columns: list[str], metrics: tuple[str, ...] = ("mean", "std", "min", "max", "median"), zscore: bool = True):
        self.columns, self.metrics, self.zscore = columns, metrics, zscore

    def transform(self, df: DataFrame) -> DataFrame:
        return statistics.with_statistics(df, self.columns, self.metrics, self.zscore)


class DataProfiler(Stage):
    """Passes rows through; `report(df)` gives statistics, outliers and missing rates of all rows."""

    name = "data_profiler"

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def report(self, df: DataFrame) -> DataFrame:
        return statistics.profile(df, self.columns).join(F.broadcast(statistics.missing_rates(df, self.columns)), "column")


class SchemaValidator(Stage):
    name = "schema_validator"

    def __init__(self, expected_schema: Mapping[str, object], strict: bool = True, reject_invalid: bool | None = None):
        self.expected, self.strict, self.reject = expected_schema, strict, strict if reject_invalid is None else reject_invalid

    def transform(self, df: DataFrame) -> DataFrame:
        return validation.schema(df, self.expected, self.strict, self.reject)


class DriftDetector(Stage):
    """Passes rows through; `report(df)` compares them with the reference rows."""

    name = "drift_detector"

    def __init__(self, reference: DataFrame, columns: list[str], method: str = "ks", drift_threshold: float = 0.1):
        self.reference, self.columns, self.method, self.threshold = reference, columns, method, drift_threshold

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def report(self, df: DataFrame) -> DataFrame:
        return statistics.union_all([statistics.detect_drift(self.reference, df, c, self.method, self.threshold) for c in self.columns])


class BatchInference(Stage):
    """A model loaded once a worker and applied to batches of a column; failures give a message instead of a prediction."""

    name = "batch_inference"

    def __init__(self, load: Callable[[], Callable[[pd.Series], Any]], input_column: str = "data", output_column: str = "prediction", returns: str = "double"):
        self.load, self.input, self.output, self.returns = load, input_column, output_column, returns

    def transform(self, df: DataFrame) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for x in batches:
                try:
                    yield pd.DataFrame({"value": list(model(x)), "error": [None] * len(x)})
                except Exception as e:
                    yield pd.DataFrame({"value": [None] * len(x), "error": [f"{type(e).__name__}: {e}"] * len(x)})

        out = df.withColumn("_p", F.pandas_udf(run, f"value {self.returns}, error string")(self.input))
        return out.withColumn(self.output, F.col("_p.value")).withColumn("inference_error", F.col("_p.error")).drop("_p")


class MultimodalFeatures(Stage):
    """Features of each modality by given extractors; without one for a modality its features stay null."""

    name = "multimodal_features"

    def __init__(self, extractors: Mapping[str, tuple[str, Callable[[pd.Series], pd.Series]]] | None = None):
        self.extractors = extractors or {}

    def transform(self, df: DataFrame) -> DataFrame:
        for m in ("video", "text", "sensor"):
            if m in self.extractors:
                column, fn = self.extractors[m]
                df = df.withColumn(f"{m}_features", F.pandas_udf(fn, "array<double>")(column))
            else:
                df = df.withColumn(f"{m}_features", F.lit(None).cast("array<double>"))
        return df


def shard(df: DataFrame, n: int, strategy: str = "hash", key: str | None = None) -> DataFrame:
    """Add shard_id: hash (md5 of the key, else id, path or episode), task_based (task, episode, trajectory or instruction) or round_robin (in key order)."""
    if strategy == "round_robin":
        order = [key] if key else df.columns
        return with_row_index(df, order, "_row").withColumn("shard_id", F.col("_row") % n).drop("_row")
    own = [key] if key else [c for c in ("id", "path", "episode_id") if c in df.columns][:1]
    names = [c for c in ("task_id", "episode_id", "trajectory_id", "instruction") if c in df.columns] if strategy == "task_based" else []
    if strategy not in ("hash", "task_based"):
        raise ValueError(f"unknown strategy {strategy}")
    value = F.coalesce(*[F.col(c).cast("string") for c in [*names, *own]], row_key(df))
    return df.withColumn("shard_id", md5_mod(value, n))


class EpisodeDetector(Stage):
    name = "episode_detector"

    def __init__(self, min_length: int = 1, max_length: int | None = None):
        self.least, self.most = min_length, max_length

    def transform(self, df: DataFrame) -> DataFrame:
        return episodes.episode_bounds(episodes.detect_episodes(df), "episode_id", "step", self.least, self.most)


def align_clocks(df: DataFrame) -> DataFrame:
    """Times of the modalities that have a column of their own; rows whose times lie apart get a warning. Without such a column, as it is."""
    clocks = {m: f"{m}_timestamp" for m in ("video", "sensor", "text") if f"{m}_timestamp" in df.columns}
    if not clocks:
        return df
    out = episodes.align_times(df, clocks)
    return out.withColumn("temporal_consistency_warning", F.when(~F.col("temporal_consistent"), True))


def default_stages() -> list[Stage]:
    """The usual chain; it works on any mix of records."""
    return [
        stage(episodes.detect_episodes), stage(align_clocks), TextProcessor(), stage(validation.completeness), stage(validation.physics, rejecting=False),
        stage(validation.cross_modal), stage(validation.corruption, checksum=False), stage(validation.quality), stage(validation.anomaly),
    ]
