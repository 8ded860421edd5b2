"""Running things: checkpoints, incremental file sets, retries, time limits, lineage, path checks, health."""

from __future__ import annotations

import json
import posixpath
import random
import re
import threading
import time
import uuid
from collections.abc import Callable
from functools import wraps
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import DANGEROUS


class Checkpoints:
    """Tables with their state below one folder; the newest `keep` stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self) -> tuple[Any, Callable[[str], Any]]:
        jvm = self.spark._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, state: dict[str, Any], name: str | None = None) -> DataFrame:
        """Write, and give back the frame read from what was written. `state` should hold next_stage."""
        own = name or f"checkpoint_{time.time_ns():020d}"
        path = f"{self.folder}/{own}"
        df.write.mode("overwrite").parquet(f"{path}/data")
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        fs, at = self._fs()
        for old in self.list()[: -self.keep]:
            fs.delete(at(f"{self.folder}/{old}"), True)
        return self.spark.read.schema(df.schema).parquet(f"{path}/data")

    def list(self) -> list[str]:
        fs, at = self._fs()
        if not fs.exists(at(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at(self.folder)) if fs.exists(at(f"{self.folder}/{s.getPath().getName()}/state/_SUCCESS")))

    def info(self, name: str | None = None) -> dict[str, Any]:
        known = self.list()
        if not known:
            raise FileNotFoundError(f"no checkpoint below {self.folder}")
        own = name or known[-1]
        return json.loads(self.spark.read.json(f"{self.folder}/{own}/state").first()["state"]) | {"name": own}

    def load(self, name: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
        state = self.info(name)
        return self.spark.read.parquet(f"{self.folder}/{state['name']}/data"), state


def file_snapshot(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, hash): a hash of path, modification time and size of every file below the paths; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime", "length")
    return files.select("path", F.sha2(F.concat_ws(":", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")), 256).alias("hash"))


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or unchanged."""
    both = previous.select("path", F.col("hash").alias("_a")).join(current.select("path", F.col("hash").alias("_b")), "path", "outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified").otherwise("unchanged")
    return both.select("path", kind.alias("change"))


class Incremental:
    """Files that weren't processed yet in their present form; call `commit` after success."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state

    def _known(self) -> DataFrame:
        try:
            return self.spark.read.schema("path string, hash string").parquet(self.state)
        except Exception:
            return self.spark.createDataFrame([], "path string, hash string")

    def pending(self, paths: str | list[str]) -> DataFrame:
        known = self._known()
        return file_snapshot(self.spark, paths).join(known, ["path", "hash"], "left_anti")

    def commit(self, done: DataFrame) -> None:
        done.select("path", "hash").write.mode("append").parquet(self.state)


def retry(retries: int = 3, initial_delay: float = 1.0, backoff: float = 2.0, max_delay: float = 60.0, exceptions: tuple[type[BaseException], ...] = (Exception,), jitter: bool = True, on_retry: Callable[[int, BaseException], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Repeat a failing call up to `retries` times with growing pauses."""

    def mark(func: Callable) -> Callable:
        @wraps(func)
        def run(*args: Any, **kwargs: Any) -> Any:
            delay = initial_delay
            for attempt in range(retries + 1):
                try:
                    return func(*args, **kwargs)
                except exceptions as e:
                    if attempt == retries:
                        raise
                    if on_retry:
                        on_retry(attempt + 1, e)
                    sleep(delay * (random.uniform(0.5, 1.0) if jitter else 1.0))
                    delay = min(delay * backoff, max_delay)

        return run

    return mark


def retry_cloud_storage(max_retries: int = 3, initial_delay: float = 1.0, backoff_factor: float = 2.0, max_delay: float = 60.0) -> Callable:
    return retry(max_retries, initial_delay, backoff_factor, max_delay, (OSError, ConnectionError, TimeoutError))


def time_limit(seconds: float, spark: SparkSession | None = None) -> Callable:
    """Raise TimeoutError when a call takes longer; its Spark jobs are cancelled."""

    def mark(func: Callable) -> Callable:
        @wraps(func)
        def run(*args: Any, **kwargs: Any) -> Any:
            session = spark or SparkSession.getActiveSession()
            tag, out = f"limit-{uuid.uuid4().hex}", {}

            def call() -> None:
                if session:
                    session.addTag(tag)
                try:
                    out["value"] = func(*args, **kwargs)
                except BaseException as e:
                    out["error"] = e

            t = threading.Thread(target=call, daemon=True)
            t.start()
            t.join(seconds)
            if t.is_alive():
                if session:
                    session.interruptTag(tag)
                raise TimeoutError(f"{func.__name__} took more than {seconds} s")
            if "error" in out:
                raise out["error"]
            return out.get("value")

        return run

    return mark


def partial_failure(func: Callable[[], Any], fallback: Any = None, context: str = "", errors: list[str] | None = None) -> Any:
    """The value of a call, or a fallback; the message goes to `errors`."""
    try:
        return func()
    except Exception as e:
        if errors is not None:
            errors.append(f"{context}: {type(e).__name__}: {e}" if context else f"{type(e).__name__}: {e}")
        return fallback


class Lineage:
    """Start, completion and failure of runs as JSON lines."""

    def __init__(self, path: str):
        self.path = path

    def _write(self, event: dict[str, Any]) -> None:
        with open(self.path, "a") as f:
            f.write(json.dumps(event | {"time": time.time()}) + "\n")

    def start(self, job: str, inputs: list[str], output: str | None) -> str:
        run = uuid.uuid4().hex
        self._write({"type": "START", "run": run, "job": job, "inputs": inputs, "outputs": [output]})
        return run

    def complete(self, run: str, facts: dict[str, Any] | None = None) -> None:
        self._write({"type": "COMPLETE", "run": run} | (facts or {}))

    def fail(self, run: str, message: str) -> None:
        self._write({"type": "FAIL", "run": run, "message": message})


class Metrics:
    """Counts and observed values of runs by name, safe to use from several threads."""

    def __init__(self) -> None:
        self._lock, self.counts, self.values = threading.Lock(), {}, {}

    def count(self, name: str, by: float = 1) -> None:
        with self._lock:
            self.counts[name] = self.counts.get(name, 0) + by

    def observe(self, name: str, value: float) -> None:
        with self._lock:
            n, total, low, high = self.values.get(name, (0, 0.0, value, value))
            self.values[name] = n + 1, total + value, min(low, value), max(high, value)

    def rows(self) -> list[tuple[str, str, float]]:
        """(name, kind, value): count, sum, min, max and mean of what was observed."""
        with self._lock:
            out = [(k, "total", float(v)) for k, v in self.counts.items()]
            for k, (n, total, low, high) in self.values.items():
                out += [(k, "count", float(n)), (k, "sum", total), (k, "min", low), (k, "max", high), (k, "mean", total / n)]
        return sorted(out)


class Context:
    """Named values that the parts of an application share."""

    def __init__(self, **values: Any):
        self._lock, self._values = threading.RLock(), dict(values)

    def set(self, name: str, value: Any) -> None:
        with self._lock:
            self._values[name] = value

    def get(self, name: str, default: Any = None) -> Any:
        with self._lock:
            return self._values.get(name, default)

    def update(self, **values: Any) -> None:
        with self._lock:
            self._values.update(values)

    def clear(self) -> None:
        with self._lock:
            self._values.clear()

    def __contains__(self, name: str) -> bool:
        return name in self._values


def tuned(input_bytes: int, cores: int, executor_memory: int, per_core: int | None = None, row_bytes: int = 1_000) -> dict[str, int]:
    """Settings for an input: scan and shuffle partitions that fit a task's share of the memory with room to spare, at least two a core, and Arrow batches of about 8 MB."""
    share = executor_memory // max(1, per_core or cores)
    target = max(1 << 20, min(128 << 20, share // 8))
    return {
        "spark.sql.files.maxPartitionBytes": target, "spark.sql.shuffle.partitions": max(2 * cores, -(-input_bytes // target)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": target, "spark.sql.execution.arrow.maxRecordsPerBatch": max(100, min(10_000, (8 << 20) // max(1, row_bytes))),
    }


def validate_path(path: str, max_length: int = 4096) -> tuple[bool, str]:
    if not path:
        return False, "empty path"
    if len(path) > max_length or "\0" in path:
        return False, "too long, or a NUL in it"
    for p in DANGEROUS:
        if re.search(p, path, re.IGNORECASE):
            return False, f"dangerous pattern {p}"
    return True, ""


def sanitize_path(path: str, allow_absolute: bool = True, root: str | None = None) -> str:
    """Normalised path; traversal out of `root` (or upwards) is refused."""
    clean = posixpath.normpath(path.replace("\0", ""))
    if clean.startswith("..") or (not allow_absolute and posixpath.isabs(clean)):
        raise ValueError(f"path {path!r} is not allowed")
    if root and not posixpath.normpath(posixpath.join(root, clean)).startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"path {path!r} leaves {root}")
    return clean


def sanitize_url(url: str, allowed_schemes: tuple[str, ...] = ("http", "https", "s3", "s3a", "gs", "hdfs", "file")) -> str:
    parts = urlparse(url.strip())
    if parts.scheme not in allowed_schemes:
        raise ValueError(f"scheme {parts.scheme!r} is not allowed")
    return parts.geturl()


def validate_config(config: dict[str, Any]) -> list[str]:
    """Problems of a configuration: bad paths, negative numbers."""
    out = []
    for k, v in config.items():
        if isinstance(v, str) and ("path" in k or "dir" in k) and not validate_path(v)[0]:
            out.append(f"{k}: {validate_path(v)[1]}")
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v < 0:
            out.append(f"{k}: negative")
    return out


def health(spark: SparkSession) -> dict[str, Any]:
    """Whether the session runs jobs, and its size."""
    began = time.time()
    ok = spark.range(10).count() == 10
    return {"healthy": ok, "seconds": time.time() - began, "parallelism": spark.sparkContext.defaultParallelism, "version": spark.version, "active_stages": len(spark.sparkContext.statusTracker().getActiveStageIds())}
