"""Pipelines: sources, a chain of stages, an output; as objects, by a fluent builder, from YAML, and several at once."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce, wraps
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions.hashing import row_key
from millrace.operators import stages as S
from millrace.operators.order import with_row_index
from millrace.plans.execution import Checkpoints, Lineage, Metrics
from millrace.sources.registry import load
from millrace.sources.robotics import read_generated_videos, read_rendered, read_simulation, read_trajectories
from millrace.sources.writers import write, write_output

COMPUTE_MODES = ("auto", "cpu", "gpu")
DEDUP_METHODS = ("fuzzy", "semantic", "both", "sequence")
SOURCE_TYPES: dict[str, Callable[..., DataFrame]] = {
    "path": lambda s, path, **o: load(s, path, **o), "trajectories": read_trajectories,
    "simulation": lambda s, path, robot_type="humanoid", **o: read_simulation(s, path, robot_type), "rendered": lambda s, path, **o: read_rendered(s, path), "generated_videos": lambda s, path, **o: read_generated_videos(s, path),
}


def combine(frames: list[DataFrame], mode: str = "independent", keys: list[str] | None = None, how: str = "inner") -> DataFrame | list[DataFrame]:
    """independent: the list as it is; union: all rows by column name; join: a left fold of equi-joins."""
    if mode == "independent":
        return frames
    if mode == "union":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if mode == "join":
        if not keys:
            raise ValueError("join needs join keys")
        return reduce(lambda a, b: Frame(a).join(Frame(b), on=keys, how=how).df, frames)
    raise ValueError(f"unknown mode {mode}")


@dataclass
class PipelineConfig:
    """Checked options of a pipeline."""

    output: str | None = None
    batch_size: int = 100
    num_cpus: int | None = None
    num_gpus: int = 0
    compute_mode: str = "auto"
    checkpoint_interval: int | None = None
    checkpoint_dir: str | None = None
    partition_by: list[str] = field(default_factory=list)
    rows_per_file: int = 1_000_000
    compression: str = "snappy"
    output_format: str | None = None
    dedup_method: str | None = None
    similarity_threshold: float = 0.95
    dedup_options: dict[str, Any] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("batch_size", "rows_per_file"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.checkpoint_interval is not None and self.checkpoint_interval <= 0:
            raise ValueError("checkpoint_interval must be positive")
        if self.num_gpus < 0 or (self.num_cpus or 0) < 0:
            raise ValueError("resources can't be negative")
        if self.compute_mode not in COMPUTE_MODES:
            raise ValueError(f"compute_mode must be one of {COMPUTE_MODES}")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be in [0, 1]")
        if self.dedup_method is not None and self.dedup_method not in DEDUP_METHODS:
            raise ValueError(f"dedup_method must be one of {DEDUP_METHODS}")

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> PipelineConfig:
        known = set(cls.__dataclass_fields__)
        return cls(**{k: v for k, v in given.items() if k in known}, options={k: v for k, v in given.items() if k not in known} | given.get("options", {}))


def _source(spec: Any) -> dict[str, Any]:
    if isinstance(spec, dict):
        if "path" not in spec and "frame" not in spec:
            raise ValueError("a source needs a path")
        return spec
    return {"frame": spec} if isinstance(spec, (Frame, DataFrame)) else {"path": str(spec)}


class Pipeline:
    """Sources, stages and an output. `run` builds one lazy plan and writes it once.

    With a dedup_method the given stages are followed by a deduplication with the similarity_threshold; dedup_options are
    its further arguments (id_col, column, embedding, cluster).
    """

    def __init__(self, sources: Any, output: str | None = None, stages: Iterable[Any] = (), spark: SparkSession | None = None, **options: Any):
        listed = sources if isinstance(sources, list) else [sources]
        if not listed:
            raise ValueError("a pipeline needs a source")
        self.sources = [_source(s) for s in listed]
        self.config = PipelineConfig.from_dict({"output": output} | options)
        self.batch_size: int | None = options.get("batch_size")  # Spark's own unless given
        if output and any(s.get("path") == output for s in self.sources):
            raise ValueError("the output can't be a source")
        self.stages: list[S.Stage] = [as_stage(s) for s in stages]
        self.dedup: S.Stage | None = None
        if method := self.config.dedup_method:
            self.dedup = as_stage(deduplication(method, self.config.similarity_threshold, **self.config.dedup_options), f"dedup_{method}")
            self.stages.append(self.dedup)
        self.spark = spark

    @classmethod
    def create(cls, sources: Any, output: str | None = None, enable_gpu: bool = False, **options: Any) -> Pipeline:
        return cls(sources, output, **options)

    from_paths = cpu = create

    def add_stage(self, stage: Any, name: str | None = None, **_: Any) -> Pipeline:
        self.stages.append(as_stage(stage, name))
        return self

    def add_source(self, source: Any) -> Pipeline:
        """Another source, united with the others when read; also an object with generate() or load()."""
        made = next((getattr(source, m)() for m in ("generate", "load") if hasattr(source, m)), source)
        self.sources.append(_source(made))
        return self

    add_simulation_data = add_synthetic_data = add_rendered_data = add_synthetic_generator = add_source

    def get_stage_names(self) -> list[str]:
        return [s.name for s in self.stages]

    def get_status(self) -> dict[str, Any]:
        return {"sources": len(self.sources), "stages": self.get_stage_names(), "output": self.config.output, "compute_mode": self.config.compute_mode}

    def read(self) -> DataFrame:
        parts = []
        for s in self.sources:
            if "frame" in s:
                parts.append(s["frame"].df if isinstance(s["frame"], Frame) else s["frame"])
                continue
            options = {k: v for k, v in s.items() if k not in ("path", "type")}
            parts.append(SOURCE_TYPES[s.get("type", "path")](self._session(), s["path"], **options))
        return combine(parts, "union")

    def _session(self) -> SparkSession:
        return self.spark or SparkSession.active()

    def plan(self) -> DataFrame:
        """The whole chain as one lazy plan."""
        return reduce(lambda df, s: s.transform(df), self.stages, self.read())

    def profile(self) -> list[dict[str, Any]]:
        """Seconds and rows of each stage, by writing what each gives to the shared folder."""
        from millrace.session import cut

        out, df = [], cut(self.read(), "profile")
        for s in self.stages:
            began = time.time()
            df = cut(s.transform(df), "profile")
            out.append({"stage": s.name, "seconds": time.time() - began, "rows": df.count()})
        return out

    def run(self, resume_from: str | None = None, lineage: Lineage | None = None, metrics: Metrics | None = None) -> dict[str, Any]:
        """Run the chain and write the output; returns counts and times, and gives them to `metrics`. The batch size holds for this run only."""
        spark, size = self._session(), "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(size)
        if self.batch_size:
            spark.conf.set(size, self.batch_size)
        try:
            result = self._run(resume_from, lineage)
        except Exception:
            if metrics:
                metrics.count("runs_failed")
            raise
        finally:
            spark.conf.set(size, before)
        if metrics:
            metrics.count("runs")
            metrics.count("rows_written", result["rows"])
            metrics.observe("run_seconds", result["seconds"])
        return result

    def _run(self, resume_from: str | None, lineage: Lineage | None) -> dict[str, Any]:
        """With a checkpoint_interval a table is written after every so many stages, and `resume_from` goes on at the stage after
        the named (or, with 'latest', the last) checkpoint.
        """
        began, name = time.time(), uuid.uuid4().hex[:8]
        keep = Checkpoints(self._session(), self.config.checkpoint_dir) if self.config.checkpoint_dir else None
        event = lineage.start(name, [s.get("path", "frame") for s in self.sources], self.config.output) if lineage else None
        try:
            start = 0
            if resume_from and keep:
                df, state = keep.load(None if resume_from == "latest" else resume_from)
                start = state["next_stage"]
            else:
                df = self.read()
            for i, s in enumerate(self.stages[start:], start):
                df = s.transform(df)
                if keep and self.config.checkpoint_interval and (i + 1) % self.config.checkpoint_interval == 0:
                    df = keep.save(df, {"next_stage": i + 1, "stages": self.get_stage_names()})
            seen = Observation("written")
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            if self.config.output:
                if self.config.output_format and self.config.output_format != "parquet":
                    write(df, self.config.output, self.config.output_format)
                else:
                    write_output(df, self.config.output, self.config.partition_by, self.config.rows_per_file, self.config.compression)
                rows = seen.get["rows"]
            else:
                rows = df.count()
        except Exception as e:
            if event:
                lineage.fail(event, str(e))
            raise
        if event:
            lineage.complete(event, {"rows": rows})
        return {"rows": rows, "seconds": time.time() - began, "stages": self.get_stage_names(), "output": self.config.output}

    def __add__(self, other: Pipeline) -> Pipeline:
        """Sources of both; the left output and stages win."""
        out = Pipeline([*self.sources, *other.sources], self.config.output or other.config.output, self.stages or other.stages, self.spark or other.spark)
        out.config, out.dedup, out.batch_size = self.config, self.dedup, self.batch_size
        return out

    def to_yaml(self, path: str) -> None:
        import yaml

        spec = {"sources": [s for s in self.sources if "path" in s], "output": self.config.output, "compute_mode": self.config.compute_mode, "stages": [s.name for s in self.stages if s is not self.dedup]}
        if self.dedup:
            spec |= {k: getattr(self.config, k) for k in ("dedup_method", "similarity_threshold", "dedup_options")}
        with open(path, "w") as f:
            yaml.safe_dump(spec, f, sort_keys=False)


def as_stage(stage: Any, name: str | None = None) -> S.Stage:
    if isinstance(stage, str):
        return Registry.stages.create(stage)
    if isinstance(stage, S.Stage):
        return stage
    if hasattr(stage, "transform") or hasattr(stage, "process"):
        return S.FunctionStage(getattr(stage, "transform", None) or stage.process, name or type(stage).__name__)
    if callable(stage):
        return S.FunctionStage(stage, name)
    raise TypeError(f"not a stage: {stage!r}")


class Registry:
    """Names -> classes or factories."""

    stages: Registry
    validators: Registry
    datasources: Registry
    loaders: Registry

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, component: Any = None, factory: Callable[..., Any] | None = None) -> Any:
        """Usable as a decorator when neither is given."""
        made = factory or component
        if made is None:
            return lambda c: self.register(name, c) or c
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = made
        return None

    def create(self, name: str, *args: Any, **options: Any) -> Any:
        if name not in self.known:
            raise KeyError(f"unknown component {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name](*args, **options)

    def names(self) -> list[str]:
        return sorted(self.known)


Registry.stages, Registry.validators, Registry.datasources, Registry.loaders = Registry(), Registry(), Registry(), Registry()
for _cls in (S.TextProcessor, S.SensorProcessor, S.VideoProcessor, S.QualityFilter, S.DataTransformer, S.FeatureEngineering, S.DataAggregator, S.ColumnAnalytics, S.DataProfiler, S.SchemaValidator, S.DriftDetector, S.BatchInference, S.MultimodalFeatures, S.EpisodeDetector, S.IsolationOutliers):
    Registry.stages.register(_cls.name, _cls)
for _name, _fn in (("completeness", S.validation.completeness), ("physics", S.validation.physics), ("cross_modal", S.validation.cross_modal), ("corruption", S.validation.corruption), ("quality_scorer", S.validation.quality), ("anomaly_detector", S.validation.anomaly), ("instruction_grounding", S.validation.ground_instructions)):
    Registry.validators.register(_name, factory=lambda _fn=_fn, reject_invalid=None, **o: S.stage(_fn, **(o | _rejecting(_fn, reject_invalid))))
    Registry.stages.register(_name, factory=lambda _fn=_fn, **o: S.stage(_fn, **o))
for _name, _fn in SOURCE_TYPES.items():
    Registry.datasources.register(_name, _fn)
    Registry.loaders.register(_name, _fn)


def _rejecting(fn: Callable, reject: bool | None) -> dict[str, Any]:
    if reject is None:
        return {}
    return {"allow_partial": not reject} if fn is S.validation.completeness else {"rejecting": reject} if fn in (S.validation.physics, S.validation.cross_modal) else {}


def create_stage(stage_type: str, config: dict[str, Any] | None = None, **options: Any) -> S.Stage:
    return Registry.stages.create(stage_type, **(config or {}) | options)


def create_validator(validator_type: str, reject_invalid: bool = False, **options: Any) -> S.Stage:
    return Registry.validators.create(validator_type, reject_invalid=reject_invalid, **options)


def create_datasource(datasource_type: str, spark: SparkSession, paths: Any, **options: Any) -> DataFrame:
    return Registry.datasources.create(datasource_type, spark, paths, **options)


create_loader = create_datasource


def task(name: str | Callable | None = None, retries: int = 0, timeout: float | None = None, tags: Iterable[str] = (), **_: Any) -> Any:
    """Mark a function of a DataFrame as a stage; retries and timeout hold for its call."""
    from millrace.plans.execution import retry, time_limit

    def mark(func: Callable) -> Callable:
        run = retry(retries)(func) if retries else func
        if timeout:
            run = time_limit(timeout)(run)
        out = wraps(func)(lambda *a, **k: run(*a, **k))
        out.task_name, out.task_tags, out.task_retries, out.task_timeout = name if isinstance(name, str) else func.__name__, tuple(tags), retries, timeout
        return out

    return mark(name) if callable(name) else mark


class PipelineBuilder:
    """Fluent construction; `build()` checks and gives the pipeline."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark, self.sources, self.stages, self.settings = spark, [], [], {}

    def source(self, source_type: str, path: Any, **options: Any) -> PipelineBuilder:
        if source_type not in SOURCE_TYPES and source_type not in ("video", "text", "sensor", "file"):
            raise ValueError(f"unknown source type {source_type}")
        self.sources.append({"frame": path} if isinstance(path, (Frame, DataFrame)) else {"type": source_type if source_type in SOURCE_TYPES else "path", "path": path, **options})
        return self

    def simulation(self, path: str, robot_type: str = "humanoid", **_: Any) -> PipelineBuilder:
        return self.source("simulation", path, robot_type=robot_type)

    def rendered(self, path: str, **_: Any) -> PipelineBuilder:
        return self.source("rendered", path)

    def generated_videos(self, path: str, **_: Any) -> PipelineBuilder:
        return self.source("generated_videos", path)

    def stage(self, stage: Any, name: str | None = None) -> PipelineBuilder:
        self.stages.append(as_stage(stage, name or getattr(stage, "task_name", None)))
        return self

    def profile(self, profile_columns: list[str] | None = None, **_: Any) -> PipelineBuilder:
        return self.stage(S.DataProfiler(profile_columns))

    def validate(self, expected_schema: dict[str, Any], strict: bool = True, **_: Any) -> PipelineBuilder:
        return self.stage(S.SchemaValidator(expected_schema, strict))

    def infer(self, load_model: Callable, input_column: str = "data", **options: Any) -> PipelineBuilder:
        return self.stage(S.BatchInference(load_model, input_column, **{k: v for k, v in options.items() if k in ("output_column", "returns")}))

    def drift(self, reference: DataFrame, columns: list[str], drift_threshold: float = 0.1, **options: Any) -> PipelineBuilder:
        return self.stage(S.DriftDetector(reference, columns, drift_threshold=drift_threshold, **options))

    def features(self, feature_functions: dict[str, Any], **options: Any) -> PipelineBuilder:
        return self.stage(S.FeatureEngineering(feature_functions, **options))

    def transform(self, transform_func: Callable, **options: Any) -> PipelineBuilder:
        return self.stage(S.DataTransformer(transform_func, **options))

    def aggregate(self, group_by: list[str], aggregations: dict[str, Any], **_: Any) -> PipelineBuilder:
        return self.stage(S.DataAggregator(group_by, aggregations))

    def dedup(self, method: str = "fuzzy", similarity_threshold: float = 0.95, id_col: str = "id", column: str | None = None, **options: Any) -> PipelineBuilder:
        """fuzzy: near-duplicate texts; semantic: embeddings; both; sequence: equal arrays. Only the first of each stays."""
        return self.stage(deduplication(method, similarity_threshold, id_col, column, **options), f"dedup_{method}")

    def output(self, output_path: str) -> PipelineBuilder:
        if not output_path:
            raise ValueError("the output path is empty")
        self.settings["output"] = output_path
        return self

    def batch(self, batch_size: int) -> PipelineBuilder:
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        self.settings["batch_size"] = batch_size
        return self

    def streaming(self, enabled: bool = True) -> PipelineBuilder:
        self.settings["streaming"] = enabled
        return self

    def checkpoint(self, interval: int, directory: str | None = None) -> PipelineBuilder:
        if interval <= 0:
            raise ValueError("interval must be positive")
        self.settings |= {"checkpoint_interval": interval, "checkpoint_dir": directory}
        return self

    def options(self, **options: Any) -> PipelineBuilder:
        self.settings |= options
        return self

    config = options

    def gpu(self, num_gpus: int = 1) -> PipelineBuilder:
        """Accepted; Spark's own resource settings decide."""
        if num_gpus < 0:
            raise ValueError("num_gpus can't be negative")
        return self

    def cpu(self, num_cpus: int | None = None) -> PipelineBuilder:
        return self

    gpu_store = gpu

    def build(self) -> Pipeline:
        if not self.sources:
            raise ValueError("add a source first")
        settings = dict(self.settings)
        return Pipeline(self.sources, settings.pop("output", None), self.stages, self.spark, **settings)

    def run(self) -> dict[str, Any]:
        return self.build().run()


def deduplication(method: str, threshold: float, id_col: str = "id", column: str | None = None, **options: Any) -> Callable[[DataFrame], DataFrame]:
    """The first of each set of duplicates, by `id_col` or, without that column, in an order fixed by the rows' values.

    Rows are numbered, so ids may be of any type, null or, after a union of sources, used twice.
    """
    from millrace.operators import dedup as D

    def keep(df: DataFrame, decided: DataFrame) -> DataFrame:
        gone = decided.filter("not keep").select(F.col("id").alias("_dedup"))
        return df.join(gone, "_dedup", "left_anti")

    def run(df: DataFrame) -> DataFrame:
        df = with_row_index(df.withColumn("_key", row_key(df)), [*([id_col] if id_col in df.columns else []), "_key"], "_dedup").drop("_key")
        if method in ("fuzzy", "both"):
            df = keep(df, D.dedup_texts(df, "_dedup", column or ("text" if "text" in df.columns else "content"), threshold))
        if method in ("semantic", "both"):
            df = keep(df, D.dedup_embeddings(df, "_dedup", options.get("embedding", "embedding"), threshold, cluster=options.get("cluster")))
        if method == "sequence":
            df = keep(df, D.dedup_sequences(df, "_dedup", column or "sequence"))
        return df.drop("_dedup")

    if unknown := set(options) - {"embedding", "cluster"}:
        raise ValueError(f"unknown options {sorted(unknown)}")
    if method not in DEDUP_METHODS:
        raise ValueError(f"unknown method {method}")
    return run


def load_from_yaml(path: str, spark: SparkSession | None = None) -> Pipeline | MultiPipelineRunner:
    """One pipeline, or with `pipelines:` several with shared `defaults` and a `combine` rule."""
    import yaml

    with open(path) as f:
        spec = yaml.safe_load(f)
    if "pipelines" in spec:
        defaults = spec.get("defaults", {})
        return MultiPipelineRunner([_from_spec(defaults | one, spark, i) for i, one in enumerate(spec["pipelines"])], spec.get("combine"), spark)
    return _from_spec(spec, spark)


def _from_spec(spec: dict[str, Any], spark: SparkSession | None, index: int = 0) -> Pipeline:
    for need in ("sources", "output"):
        if not spec.get(need):
            raise ValueError(f"pipeline {spec.get('name', index)} needs {need}")
    stages = [Registry.stages.create(s) if isinstance(s, str) else Registry.stages.create(s["type"], **{k: v for k, v in s.items() if k != "type"}) for s in spec.get("stages", [])]
    rest = {k: v for k, v in spec.items() if k not in ("sources", "output", "stages", "name")}
    return Pipeline(spec["sources"], spec["output"], stages, spark, **rest)


class MultiPipelineRunner:
    """Several pipelines at once in one session, then combined: {mode, join_keys, how, output}."""

    def __init__(self, pipelines: list[Pipeline], combine_rule: dict[str, Any] | None = None, spark: SparkSession | None = None, workers: int = 4):
        self.pipelines, self.rule, self.spark, self.workers = pipelines, combine_rule or {"mode": "independent"}, spark, workers
        if self.rule.get("mode") == "join" and not self.rule.get("join_keys"):
            raise ValueError("combining by join needs join_keys")

    def run(self) -> dict[str, Any]:
        with ThreadPoolExecutor(self.workers) as pool:
            results = list(pool.map(lambda p: p.run(), self.pipelines))
        out: dict[str, Any] = {"pipelines": results}
        if self.rule.get("mode", "independent") != "independent":
            spark = self.spark or SparkSession.active()
            frames = [spark.read.parquet(p.config.output) for p in self.pipelines]
            df = combine(frames, self.rule["mode"], self.rule.get("join_keys"), self.rule.get("how", "inner"))
            if self.rule.get("output"):
                write_output(df, self.rule["output"])
                df = spark.read.parquet(self.rule["output"])
            out["combined"] = df
        return out


def pipeline(sources: Any, output: str | None = None, **options: Any) -> Pipeline:
    return Pipeline.create(sources, output, **options)


def simple(input_path: str, output_path: str, stages: Iterable[Any] | None = None, **options: Any) -> Pipeline:
    return Pipeline(input_path, output_path, S.default_stages() if stages is None else stages, **options)


def profile(input_path: str, output_path: str, profile_columns: list[str] | None = None, **options: Any) -> Pipeline:
    return Pipeline(input_path, output_path, [S.DataProfiler(profile_columns)], **options)


def validate(input_path: str, output_path: str, expected_schema: dict[str, Any], strict: bool = True, **options: Any) -> Pipeline:
    return Pipeline(input_path, output_path, [S.SchemaValidator(expected_schema, strict)], **options)


def infer(input_path: str, output_path: str, load_model: Callable, input_column: str = "data", **options: Any) -> Pipeline:
    return Pipeline(input_path, output_path, [S.BatchInference(load_model, input_column)], **options)


def save_spec(path: str, spec: dict[str, Any]) -> None:
    """A pipeline's description beside its output."""
    with open(posixpath.join(path, "pipeline.json"), "w") as f:
        json.dump(spec, f, indent=1)
