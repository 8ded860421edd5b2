"""Small stores on parquet: vectors with search, and features with point-in-time lookup."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import nearest
from millrace.operators.order import asof_join

DIMENSION, LIMIT, MAX_DISTANCE = 768, 10, 0.3


class VectorStore:
    """Rows of (id, embedding, text, metadata) below a folder."""

    SCHEMA = "id bigint, embedding array<float>, text string, metadata string"

    def __init__(self, spark: SparkSession, path: str, dimension: int = DIMENSION):
        self.spark, self.path, self.dimension = spark, path, dimension

    def add(self, df: DataFrame, id_col: str = "id", embedding: str = "embedding", text: str | None = "text", metadata: str | None = None) -> None:
        """Append; a row whose embedding has another dimension fails the write."""
        size = F.assert_true(F.size(embedding) == self.dimension, F.lit(f"embeddings must have {self.dimension} numbers"))
        meta = F.to_json(F.struct(metadata)) if metadata else F.lit(None).cast("string")
        rows = df.select(
            F.col(id_col).cast("long").alias("id"), F.when(size.isNull(), F.col(embedding).cast("array<float>")).alias("embedding"),
            (F.col(text) if text else F.lit(None).cast("string")).alias("text"), meta.alias("metadata"),
        )
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def search(self, query: list[float], limit: int = LIMIT, max_distance: float | None = MAX_DISTANCE, metric: str = "l2") -> DataFrame:
        """The nearest rows of one query vector, ascending by distance."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "id bigint, embedding array<float>")
        found = nearest(self.rows(), asked, "id", "embedding", limit, metric, max_distance)
        return found.join(self.rows(), "id").select("id", "text", "metadata", "distance").orderBy("distance", "id")

    def create_index(self) -> None:
        """Nothing to do: a search reads all rows."""


class FeatureStore:
    """Feature tables by name and version, each with a description."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def register(self, name: str, df: DataFrame, entity_keys: list[str], time: str | None = None, version: str = "1", **facts: Any) -> None:
        folder = f"{self.path}/{name}/{version}"
        df.write.mode("overwrite").parquet(f"{folder}/data")
        about = json.dumps({"entity_keys": entity_keys, "time": time, "columns": df.columns} | facts)
        self.spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")

    def describe(self, name: str, version: str = "1") -> dict[str, Any]:
        return json.loads(self.spark.read.text(f"{self.path}/{name}/{version}/about").first()[0])

    def lookup(self, entities: DataFrame, names: list[str], timestamp: str | None = None, version: str = "1") -> DataFrame:
        """Entities with the features of each table: by key, or with `timestamp` the last known at that time."""
        out = entities
        for name in names:
            about = self.describe(name, version)
            table = self.spark.read.parquet(f"{self.path}/{name}/{version}/data")
            values = [c for c in about["columns"] if c not in (*about["entity_keys"], about["time"])]
            if timestamp and about["time"]:
                out = asof_join(out, table, timestamp, about["entity_keys"], values, about["time"])
            else:
                out = out.join(table.select(*about["entity_keys"], *values), about["entity_keys"], "left")
        return out
