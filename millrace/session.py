"""Session set-up, lineage cuts and input spreading shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "millrace", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A UTC session with adaptive execution on; `conf` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**settings, **(conf or {})}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temporary folder."""
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def cut(df: DataFrame, name: str, partition_hint: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage so that nothing above is computed twice; the table outlives any lost executor.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    out = df.coalesce(partition_hint) if partition_hint else df
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, factor: int = 3, least: float = 2.0) -> DataFrame:
    """Hash-partition by `keys` where the input has fewer than `least` splits a core, too few to keep all busy in a heavy stage.

    A large input has many splits and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= least * cores:
        return df
    return df.repartition(factor * cores, *keys)
