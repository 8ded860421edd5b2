"""Experiments around pipeline runs: a context with parameters and metrics, kept by a hook (by default as JSON lines)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.plans.pipeline import Pipeline

Hook = Callable[[dict[str, Any]], None]


def json_lines(path: str) -> Hook:
    def hook(event: dict[str, Any]) -> None:
        with open(path, "a") as f:
            f.write(json.dumps(event, default=str) + "\n")

    return hook


@dataclass
class Experiment:
    """What one run reports; tables are logged by their first rows."""

    name: str
    hook: Hook
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _log(self, kind: str, **facts: Any) -> None:
        self.hook({"experiment": self.name, "run": self.run_id, "kind": kind, "time": time.time(), **facts})

    def log_params(self, params: dict[str, Any]) -> None:
        self._log("params", values=params)

    def log_metrics(self, metrics: dict[str, float], step: int | None = None) -> None:
        self._log("metrics", values=metrics, step=step)

    def log_table(self, name: str, df: Any, rows: int = 100) -> None:
        self._log("table", name=name, columns=df.columns, rows=[list(r) for r in df.take(rows)])

    def log_artifact(self, path: str) -> None:
        self._log("artifact", path=path)


@contextmanager
def experiment(name: str, hook: Hook | None = None, tags: dict[str, str] | None = None) -> Iterator[Experiment]:
    """Report the start and the end, or the failure, of what runs inside."""
    run = Experiment(name, hook or (lambda event: None))
    run._log("start", tags=tags or {})
    try:
        yield run
    except Exception as e:
        run._log("failed", message=str(e))
        raise
    run._log("end")


def run_pipeline(pipeline: Pipeline, experiment_name: str, hook: Hook | None = None, **options: Any) -> dict[str, Any]:
    """Run once inside an experiment."""
    with experiment(experiment_name, hook) as run:
        run.log_params(pipeline.get_status())
        result = pipeline.run(**options)
        run.log_metrics({"rows": result["rows"], "seconds": result["seconds"]})
        return result


class ModelRegistry:
    """Where the versions of models lie, as rows of a table below a folder."""

    SCHEMA = "name string, version int, uri string, metadata string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, name: str) -> list[Any]:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.path).filter(F.col("name") == name).orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:  # nothing registered yet
            return []

    def register(self, uri: str, name: str, version: int | None = None, metadata: dict[str, Any] | None = None) -> int:
        """Add a version, the next one unless given."""
        last = self._rows(name)
        number = version or (last[0].version + 1 if last else 1)
        self.spark.createDataFrame([(name, number, uri, json.dumps(metadata or {}))], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)
        return number

    def get(self, name: str) -> dict[str, Any]:
        """The latest version."""
        last = self._rows(name)
        if not last:
            raise KeyError(f"no model {name}")
        return {"name": name, "version": last[0].version, "uri": last[0].uri, "metadata": json.loads(last[0].metadata)}
