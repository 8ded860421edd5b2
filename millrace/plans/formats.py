"""Queries that read a small fixed table back from other file formats; the files are made from the table in the shared folder."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import query, read
from millrace.session import shared_dir
from millrace.sources.registry import read_paths


def _file(s: SparkSession, name: str, data: bytes) -> str:
    """Put bytes into the shared folder, through Hadoop's file system."""
    path = f"{shared_dir(s)}/millrace/{uuid.uuid4().hex}/{name}"
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at)
    out.write(data)
    out.close()
    return path


def _nations(s: SparkSession, d: str) -> list[Row]:
    return read(s, d, "nation").orderBy("n_nationkey").limit(1000).collect()  # 25 fixed rows


def _made(name: str, make: Callable[[list[Row]], bytes], **options: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: read_paths(s, _file(s, name, make(_nations(s, d))), **options)


def _zip(rows: list[Row]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in rows:
            z.writestr(f"n{r.n_nationkey}.txt", r.n_name)
    return out.getvalue()


@query("source_archive", "SELECT 'n' || n_nationkey || '.txt' AS entry_name, length(n_name) AS size, n_name AS content FROM nation")
def source_archive(s: SparkSession, d: str) -> DataFrame:
    return _made("a.zip", _zip)(s, d).select("entry_name", "size", F.col("content").cast("string").alias("content"))


@query("source_binary", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS record_index, [n_nationkey::DOUBLE, n_regionkey / 2.0] AS data FROM nation")
def source_binary(s: SparkSession, d: str) -> DataFrame:
    pack = lambda rows: b"".join(struct.pack("<if", r.n_nationkey, r.n_regionkey / 2) for r in rows)
    return _made("a.bin", pack, struct_format="<if")(s, d).select("record_index", "data")


@query("source_numpy", "SELECT 'array' AS name, [25::BIGINT, 2::BIGINT] AS shape, (SELECT list(v ORDER BY k, i) FROM (SELECT n_nationkey AS k, 0 AS i, n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey FROM nation)) AS data")
def source_numpy(s: SparkSession, d: str) -> DataFrame:
    def save(rows: list[Row]) -> bytes:
        out = io.BytesIO()
        np.save(out, np.array([[r.n_nationkey, r.n_regionkey] for r in rows]))
        return out.getvalue()

    return _made("a.npy", save)(s, d).select("name", "shape", "data")


def _bag(rows: list[Row]) -> bytes:
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE topics(id INTEGER, name TEXT, type TEXT); CREATE TABLE messages(id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB);")
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(k, f"/region{k}", "Name") for k in range(5)])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(r.n_nationkey, r.n_regionkey, r.n_nationkey * 10**9, r.n_name.encode()) for r in rows])
    return db.serialize()


@query("source_bag", "SELECT '/region' || n_regionkey AS topic, n_nationkey::DOUBLE AS timestamp, n_nationkey::BIGINT * 1000000000 AS timestamp_ns, lower(hex(n_name)) AS data FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 2")
def source_bag(s: SparkSession, d: str) -> DataFrame:
    return _made("a.db3", _bag, topics=["/region1"], start=2.0)(s, d).select("topic", "timestamp", "timestamp_ns", F.col("message.data").alias("data"))


@query("source_sqlite", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def source_sqlite(s: SparkSession, d: str) -> DataFrame:
    def save(rows: list[Row]) -> bytes:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE n(id INTEGER, name TEXT)")
        db.executemany("INSERT INTO n VALUES (?, ?)", [(r.n_nationkey, r.n_name) for r in rows])
        db.commit()
        return db.serialize()

    return _made("a.sqlite", save)(s, d).select(F.get_json_object("row", "$.id").cast("int").alias("id"), F.get_json_object("row", "$.name").alias("name"))


@query("source_yaml", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def source_yaml(s: SparkSession, d: str) -> DataFrame:
    text = lambda rows: "\n".join(f"- {{name: {json.dumps(r.n_name)}, region: {r.n_regionkey}}}" for r in rows).encode()
    return _made("a.yaml", text)(s, d).select(F.explode(F.from_json("config", "array<struct<name: string, region: int>>")).alias("c")).select("c.*")


@query("source_pointcloud", "SELECT count(*) AS num_points, sum(n_nationkey)::DOUBLE AS sum_x, sum(n_regionkey)::DOUBLE AS sum_y FROM nation")
def source_pointcloud(s: SparkSession, d: str) -> DataFrame:
    head = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    text = lambda rows: (head.format(len(rows)) + "".join(f"{r.n_nationkey} {r.n_regionkey} 0\n" for r in rows)).encode()
    total = lambda k: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[k])
    return _made("a.ply", text)(s, d).select("num_points", total(0).alias("sum_x"), total(1).alias("sum_y"))


@query("source_robot_description", "SELECT 'link' || n_nationkey AS name, n_regionkey + 0.5 AS radius FROM nation")
def source_robot_description(s: SparkSession, d: str) -> DataFrame:
    link = '<link name="link{}"><visual><geometry><cylinder radius="{}" length="1"/></geometry></visual></link>'
    text = lambda rows: ('<robot name="r">' + "".join(link.format(r.n_nationkey, r.n_regionkey + 0.5) for r in rows) + "</robot>").encode()
    return _made("a.urdf", text)(s, d).select(F.explode("links").alias("k")).select("k.name", F.col("k.geometry.radius").alias("radius"))


@query("incremental_changes", "SELECT 'n' || n_nationkey || '.txt' AS file, CASE WHEN n_regionkey = 0 THEN 'removed' WHEN n_regionkey = 1 THEN 'added' WHEN n_regionkey = 2 THEN 'modified' ELSE 'unchanged' END AS change FROM nation")
def incremental_changes(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.execution import changes

    n = read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_regionkey").alias("r"), F.sha2("n_name", 256).alias("hash"))
    before, after = n.filter("r != 1"), n.filter("r != 0").withColumn("hash", F.when(F.col("r") == 2, "other").otherwise(F.col("hash")))
    return changes(before, after).withColumnRenamed("path", "file")
