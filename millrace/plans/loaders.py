"""Queries over readers and writers: files of many kinds made from whole tables in the shared folder, read back and held against SQL on the table."""

from __future__ import annotations

import bz2
import io
import json
import struct
import wave
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.plans.catalog import query, read
from millrace.plans.surface import facts, folder
from millrace.sources import registry as R
from millrace.sources import robotics as B
from millrace.sources import writers as W


def put(s: SparkSession, path: str, data: bytes) -> str:
    """Bytes as a file, through Hadoop's file system."""
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at)
    out.write(data)
    out.close()
    return path


def by_nation(s: SparkSession, d: str, suffix: str, make: Callable[[list[Row]], bytes], name: str = "n") -> str:
    """A folder with one file a nation, made of its suppliers."""
    root, rows = folder(s), {}
    for r in read(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").orderBy("s_suppkey").toLocalIterator():
        rows.setdefault(r.s_nationkey, []).append(r)
    for k, own in rows.items():
        put(s, f"{root}/{name}{k:02d}.{suffix}", make(own))
    return root


# --- decoded formats ---


def _packed(v: object) -> bytes:
    """A value in MessagePack."""
    if isinstance(v, dict):
        return struct.pack(">BH", 0xDE, len(v)) + b"".join(_packed(k) + _packed(x) for k, x in v.items())
    if isinstance(v, str):
        return struct.pack(">BH", 0xDA, len(v.encode())) + v.encode()
    if isinstance(v, float):
        return struct.pack(">Bd", 0xCB, v)
    return struct.pack(">Bq", 0xD3, v)


@query("source_msgpack", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier")
def source_msgpack(s: SparkSession, d: str) -> DataFrame:
    root = by_nation(s, d, "msgpack", lambda rows: b"".join(_packed({"k": r.s_suppkey, "name": r.s_name, "balance": r.s_acctbal}) for r in rows))
    return R.read_paths(s, root, "msgpack").select(F.from_json("data", "k bigint, name string, balance double").alias("x")).select("x.*")


def _bag_record(head: dict[bytes, bytes], body: bytes) -> bytes:
    h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v for k, v in head.items())
    return struct.pack("<I", len(h)) + h + struct.pack("<I", len(body)) + body


def _rosbag(rows: Iterable[Row]) -> bytes:
    """A bag whose chunks are stored plain, by bz2 and by lz4 in turn."""
    out = b"#ROSBAG V2.0\n" + _bag_record({b"op": b"\x03"}, b"")
    how = [(b"none", bytes), (b"bz2", bz2.compress), (b"lz4", _lz4)]
    for i, r in enumerate(rows):
        conn = struct.pack("<I", r.s_nationkey)
        inner = _bag_record({b"op": b"\x07", b"conn": conn, b"topic": f"/n{r.s_nationkey}".encode()}, struct.pack("<I", 10) + b"type=Names")
        inner += _bag_record({b"op": b"\x02", b"conn": conn, b"time": struct.pack("<II", r.s_suppkey, 5)}, r.s_name.encode())
        name, pack = how[i % 3]
        out += _bag_record({b"op": b"\x05", b"compression": name, b"size": struct.pack("<I", len(inner))}, pack(inner))
    return out


def _lz4(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as f:
        f.write(data)
    return sink.getvalue().to_pybytes()


_MESSAGES = "SELECT '/n' || s_nationkey AS topic, s_suppkey * 1000000000 + 5 AS timestamp_ns, lower(hex(s_name)) AS data, 'Names' AS type FROM supplier"


@query("source_rosbag", f"{_MESSAGES} WHERE s_nationkey IN (3, 4, 5)")
def source_rosbag(s: SparkSession, d: str) -> DataFrame:
    out = R.read_paths(s, by_nation(s, d, "bag", _rosbag), "rosbag", topics=["/n3", "/n4", "/n5"])
    return out.select("topic", "timestamp_ns", F.col("message.data").alias("data"), "type")


def _mcap(rows: list[Row]) -> bytes:
    """An MCAP file with plain, zstd and lz4 chunks in turn."""
    import zstandard

    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    text = lambda t: struct.pack("<I", len(t)) + t
    nation = rows[0].s_nationkey
    out = b"\x89MCAP0\r\n" + record(3, struct.pack("<H", 1) + text(b"Names") + text(b"") + text(b""))
    out += record(4, struct.pack("<HH", 7, 1) + text(f"/n{nation}".encode()) + text(b"") + struct.pack("<I", 0))
    how = [(b"", bytes), (b"zstd", zstandard.ZstdCompressor().compress), (b"lz4", _lz4)]
    for i, r in enumerate(rows):
        ns = r.s_suppkey * 10**9 + 5
        message = record(5, struct.pack("<HIQQ", 7, i, ns, ns) + r.s_name.encode())
        name, pack = how[i % 3]
        packed = pack(message)
        out += record(6, struct.pack("<QQQI", ns, ns, len(message), 0) + text(name) + struct.pack("<Q", len(packed)) + packed)
    return out + record(15, b"\0" * 4)


@query("source_mcap", _MESSAGES)
def source_mcap(s: SparkSession, d: str) -> DataFrame:
    out = R.read_paths(s, by_nation(s, d, "mcap", _mcap), "mcap", types=["Names"])
    return out.select("topic", "timestamp_ns", F.col("message.data").alias("data"), "type")


@query("source_velodyne", "SELECT s_suppkey + 0.5 AS timestamp, length(s_name) AS size, lower(hex(s_name)) AS data FROM supplier")
def source_velodyne(s: SparkSession, d: str) -> DataFrame:
    def pcap(rows: list[Row]) -> bytes:
        body = b"".join(struct.pack("<IIII", r.s_suppkey, 500_000, len(r.s_name), len(r.s_name)) + r.s_name.encode() for r in rows)
        return b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + body

    return R.read_paths(s, by_nation(s, d, "pcap", pcap), "velodyne").select("timestamp", "size", "data")


@query("source_calibration", "SELECT s_nationkey AS nation, sum(s_suppkey) AS total FROM supplier GROUP BY 1")
def source_calibration(s: SparkSession, d: str) -> DataFrame:
    def text(rows: list[Row]) -> bytes:
        return f"%YAML:1.0\nnation: {rows[0].s_nationkey}\nkeys: {[r.s_suppkey for r in rows]}\n".encode()

    out = R.read_paths(s, by_nation(s, d, "yaml", text, "calibration"), "calibration")
    return out.select(F.from_json("calibration", "nation int, keys array<bigint>").alias("c")).select("c.nation", F.aggregate("c.keys", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("source_protobuf", "SELECT s_nationkey AS nation, lower(hex(string_agg(s_name, '' ORDER BY s_suppkey))) AS raw_data FROM supplier GROUP BY 1")
def source_protobuf(s: SparkSession, d: str) -> DataFrame:
    out = R.read_paths(s, by_nation(s, d, "pb", lambda rows: "".join(r.s_name for r in rows).encode()), "protobuf")
    return out.select(F.regexp_extract("path", r"n(\d+)\.pb$", 1).cast("int").alias("nation"), "raw_data")


@query("source_tfrecord", "SELECT s_suppkey AS k, s_name AS name, round(s_acctbal::FLOAT::DOUBLE, 1) AS balance FROM supplier")
def source_tfrecord(s: SparkSession, d: str) -> DataFrame:
    """Records that the writer made, whole table, a file a partition."""
    path = folder(s)
    Frame(read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).repartition(3)).to_tfrecords(path)
    got = R.read_paths(s, path, "tfrecord").select(F.from_json("features", "k array<bigint>, name array<string>, balance array<double>").alias("x"))
    return got.select(F.col("x.k")[0].alias("k"), F.col("x.name")[0].alias("name"), F.round(F.col("x.balance")[0], 1).alias("balance"))


@query("source_las", "SELECT s_nationkey AS nation, count(*) AS num_points, sum(s_suppkey) / 100.0 AS sum_x, sum(s_suppkey % 50)::DOUBLE AS intensity FROM supplier GROUP BY 1")
def source_las(s: SparkSession, d: str) -> DataFrame:
    def las(rows: list[Row]) -> bytes:
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", bytes([1, 2])
        struct.pack_into("<I", head, 96, len(head))
        struct.pack_into("<BHI", head, 104, 0, 20, len(rows))
        struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
        return bytes(head) + b"".join(struct.pack("<iiiH6x", r.s_suppkey, r.s_nationkey, 0, r.s_suppkey % 50) for r in rows)

    out = R.read_paths(s, by_nation(s, d, "las", las), "pointcloud")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, p: a + p[0])
    return out.select(F.regexp_extract("path", r"n(\d+)\.las$", 1).cast("int").alias("nation"), "num_points", F.round(total("points"), 6).alias("sum_x"), total("colors").alias("intensity"))


@query("source_broken_file", "SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier) AS good, 1 AS broken, true AS raised")
def source_broken_file(s: SparkSession, d: str) -> DataFrame:
    """A broken file among good ones gives one row with the message, or fails the read."""
    root = by_nation(s, d, "yaml", lambda rows: b"a: 1")
    put(s, f"{root}/broken.yaml", b"a: [1")
    out = R.read_paths(s, root, "yaml", on_error="column")
    try:
        R.decode(s, [root], *R.DECODERS["yaml"]).count()
        raised = False
    except Exception:
        raised = True
    n = out.agg(F.count("config").alias("good"), F.count("read_error").alias("broken")).first()
    return facts(s, good=n.good, broken=n.broken, raised=raised)


# --- the loader and its tags ---


@query("load_text", "SELECT count(*) AS n, 'text' AS format, 'text' AS data_type, sum(length(s_name)) AS letters FROM supplier")
def load_text(s: SparkSession, d: str) -> DataFrame:
    root = by_nation(s, d, "txt", lambda rows: "\n".join(r.s_name for r in rows).encode())
    return R.load(s, root, flags=False, format="text").groupBy("format", "data_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


@query("load_sensor", "SELECT s_nationkey AS nation, 'sensor' AS data_type, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def load_sensor(s: SparkSession, d: str) -> DataFrame:
    root = by_nation(s, d, "csv", lambda rows: ("k,nation,value\n" + "".join(f"{r.s_suppkey},{r.s_nationkey},{r.s_acctbal}\n" for r in rows)).encode())
    out = R.load(s, root, flags=False, format="csv")
    return out.groupBy("nation", "data_type").agg(F.round(F.sum("value"), 2).alias("total"))


@query("load_tags_and_flags", "SELECT 'json' AS format, 'text' AS data_type, count(*) AS n, count(*) FILTER (s_suppkey % 4 = 0) AS corrupted FROM supplier")
def load_tags_and_flags(s: SparkSession, d: str) -> DataFrame:
    """Tags and corruption flags of loaded records; every fourth has an error field."""
    root = by_nation(s, d, "json", lambda rows: "\n".join(json.dumps({"text": r.s_name} | ({"error": "x"} if r.s_suppkey % 4 == 0 else {})) for r in rows).encode())
    return R.load(s, root, format="json").groupBy("format", "data_type").agg(F.count("*").alias("n"), F.sum(F.col("is_corrupted").cast("int")).alias("corrupted"))


@query("load_video_image", "SELECT k AS data_type, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS files, (SELECT sum(length(s_name)) FROM supplier)::BIGINT AS bytes FROM (VALUES ('video'), ('image')) t(k)")
def load_video_image(s: SparkSession, d: str) -> DataFrame:
    make = lambda rows: "".join(r.s_name for r in rows).encode()
    parts = []
    for suffix, kind in (("mp4", "video"), ("png", "image")):
        out = R.load(s, by_nation(s, d, suffix, make), flags=False, format=kind)
        parts.append(out.groupBy("data_type").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))
    return parts[0].unionByName(parts[1])


@query("load_audio", "SELECT s_nationkey AS nation, 8000 AS sample_rate, count(*) AS frames, round(sum(s_suppkey % 100 / 32768.0), 6) AS total FROM supplier GROUP BY 1")
def load_audio(s: SparkSession, d: str) -> DataFrame:
    def wav(rows: list[Row]) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((1, 2, 8000, len(rows), "NONE", ""))
            f.writeframes(struct.pack(f"<{len(rows)}h", *[r.s_suppkey % 100 for r in rows]))
        return out.getvalue()

    out = R.load(s, by_nation(s, d, "wav", wav), flags=False, format="audio")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.regexp_extract("path", r"n(\d+)\.wav$", 1).cast("int").alias("nation"), "sample_rate", "frames", F.round(total, 6).alias("total"))


@query("load_sql", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey < 10")
def load_sql(s: SparkSession, d: str) -> DataFrame:
    """A table written to a database and read back by a query, in parts."""
    import tempfile

    url = f"sqlite:///{tempfile.mkdtemp(dir=_local(s))}/x.db"
    W.write_sql(read(s, d, "supplier"), url, "supplier")
    return R.read_sql(s, url, "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey < 10", partitions=3)


def _local(s: SparkSession) -> str:
    """The shared folder as a path of the machine; a database file needs one that is mounted."""
    import os

    path = folder(s).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


@query("reader_custom", "SELECT s_suppkey AS k, upper(s_name) AS name FROM supplier")
def reader_custom(s: SparkSession, d: str) -> DataFrame:
    R.register_custom_reader(".pipes", lambda spark, paths, **o: spark.read.options(sep="|").schema("k bigint, name string").csv(paths), "pipes")
    root = by_nation(s, d, "pipes", lambda rows: "".join(f"{r.s_suppkey}|{r.s_name}\n" for r in rows).encode())
    return R.read_paths(s, root, "pipes").select("k", F.upper("name").alias("name"))


@query("reader_formats", "SELECT true AS has_native, true AS has_decoded, true AS has_written, true AS by_suffix, true AS by_folder")
def reader_formats(s: SparkSession, d: str) -> DataFrame:
    known, made = R.list_formats(), W.list_formats()
    return facts(
        s, has_native={"parquet", "csv", "json", "text", "image", "video"} <= set(known["native"]), has_decoded={"mcap", "rosbag", "ros2bag", "urdf", "pointcloud", "tfrecord"} <= set(known["decoded"]),
        has_written={"parquet", "json", "csv", "numpy", "tfrecords", "images"} <= set(made["native"]), by_suffix=[W.detect_writer(p) for p in ("a.csv", "a.npy", "a.tfrecord", "a")] == ["csv", "numpy", "tfrecords", "parquet"],
        by_folder=W.detect_writer("/json/a") == "json" and W.get_writer("numpy") is W.to_numpy,
    )


@query("reader_options", "SELECT count(*) AS n FROM lineitem")
def reader_options(s: SparkSession, d: str) -> DataFrame:
    """Knobs of the read reach the reader: a schema of two columns, and small splits of the session."""
    out = R.read_paths(s, f"{d}/lineitem.parquet", schema="l_orderkey bigint, l_quantity double", mergeSchema="false")
    return out.filter("l_orderkey is not null").agg(F.count("*").alias("n"))


# --- trajectories, simulations, rendered data ---


@query("trajectory_folder", "SELECT row_id, coalesce(lower(data_type), 'sensor') AS data_type, coalesce(episode_id, groot_metadata.episode_id) AS episode FROM test_groot WHERE coalesce(lower(data_type), 'sensor') IN ('sensor', 'video', 'text', 'multimodal') AND coalesce(trim(coalesce(episode_id, groot_metadata.episode_id)), 'x') <> '' AND coalesce(trim(coalesce(robot_id, groot_metadata.robot_id)), 'x') <> '' AND coalesce(trim(coalesce(task_id, groot_metadata.task_id)), 'x') <> ''")
def trajectory_folder(s: SparkSession, d: str) -> DataFrame:
    """Half of the records as parquet, half as JSON lines, read as one folder; invalid ones are left out."""
    root, df = folder(s), read(s, d, "test_groot").withColumn("observations", F.col("row_id"))
    df.filter("row_id % 2 = 0").write.parquet(f"{root}/a")
    df.filter("row_id % 2 = 1").drop("recorded_at", "received_at").write.json(f"{root}/b")
    got = B.read_trajectories(s, root)
    return got.select(F.col("observations").cast("bigint").alias("row_id"), "data_type", F.col("groot_metadata.episode_id").alias("episode"))


@query("trajectory_schema_rules", "SELECT row_id, coalesce(lower(data_type), 'sensor') NOT IN ('sensor', 'video', 'text', 'multimodal') AS bad_type, trim(coalesce(robot_id, groot_metadata.robot_id)) = '' AS empty_robot FROM test_groot WHERE coalesce(robot_id, groot_metadata.robot_id) IS NOT NULL")
def trajectory_schema_rules(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot").filter("coalesce(robot_id, groot_metadata.robot_id) is not null").withColumn("observations", F.col("row_id"))
    return B.trajectory_rows(df).select(F.col("observations").alias("row_id"), F.array_contains("trajectory_errors", "data_type").alias("bad_type"), F.array_contains("trajectory_errors", "empty:robot_id").alias("empty_robot"))


@query("simulation_rows", "SELECT coalesce(robot_id, 'humanoid') AS robot_id, 'sensor' AS data_type, row_id AS step, sensor_data.joint_positions AS positions FROM test_groot")
def simulation_rows(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    read(s, d, "test_groot").select("robot_id", "episode_id", F.col("row_id").alias("step"), F.col("sensor_data.joint_positions").alias("joint_positions")).write.parquet(f"{path}/x_trajectory.parquet")
    return B.read_simulation(s, path, "humanoid").select("robot_id", "data_type", "step", F.col("sensor_data.joint_positions").alias("positions"))


@query("simulation_space", "SELECT 'array<double>' AS dtype, max(len(sensor_data.joint_positions)) AS longest, count(*) AS n FROM test_groot")
def simulation_space(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot")
    space = B.observation_space(df, "sensor_data")["joint_positions"]
    return facts(s, dtype=space["dtype"], longest=space["shape"], n=B.loader_statistics(df)["count"])


@query("generated_videos", "SELECT s_nationkey AS nation, 'n' || s_nationkey AS prompt, CASE WHEN s_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS quality_score FROM supplier GROUP BY 1")
def generated_videos(s: SparkSession, d: str) -> DataFrame:
    """Videos with the fields of the file beside each, and a score by resolution and length."""
    root = by_nation(s, d, "mp4", lambda rows: rows[0].s_name.encode())
    for (k,) in {(r.s_nationkey,) for r in read(s, d, "supplier").select("s_nationkey").distinct().collect()}:  # 25 nations
        facts_ = {"prompt": f"n{k}", "resolution": [256, 256] if k % 2 == 0 else [128, 100], "num_frames": 48 if k % 2 == 0 else 10}
        put(s, f"{root}/n{k:02d}.json", json.dumps(facts_).encode())
    return B.read_generated_videos(s, root).select(F.regexp_extract("path", r"n(\d+)\.mp4$", 1).cast("int").alias("nation"), F.col("gen_prompt").alias("prompt"), "quality_score")


@query("video_quality", "SELECT s_suppkey, (CASE WHEN least(s_suppkey % 300, 240) >= 224 THEN 1.0 WHEN least(s_suppkey % 300, 240) >= 128 THEN 0.7 ELSE 0.3 END + CASE WHEN s_nationkey * 2 >= 30 THEN 1.0 WHEN s_nationkey * 2 >= 10 THEN 0.7 ELSE 0.3 END) / 2 AS score FROM supplier")
def video_quality(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.validation import video_quality as score

    return read(s, d, "supplier").select("s_suppkey", score(F.col("s_suppkey") % 300, F.lit(240), F.col("s_nationkey") * 2).alias("score"))


@query("rendered_folder", "SELECT kind, count(DISTINCT s_nationkey) AS files FROM supplier, (VALUES ('image'), ('depth'), ('semantic'), ('annotation')) t(kind) GROUP BY 1")
def rendered_folder(s: SparkSession, d: str) -> DataFrame:
    root = folder(s)
    for (k,) in [(r.s_nationkey,) for r in read(s, d, "supplier").select("s_nationkey").distinct().collect()]:  # 25 nations
        for name in (f"rgb_{k}.png", f"depth_{k}.npy", f"semantic_{k}.png", f"boxes_{k}.json"):
            put(s, f"{root}/{name}", b"x")
    return B.read_rendered(s, root).groupBy("kind").agg(F.count("*").alias("files"))


# --- sinks ---


@query("sink_numpy", "SELECT count(*) AS n, sum(c_custkey)::DOUBLE AS total FROM customer")
def sink_numpy(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    Frame(read(s, d, "customer")).to_numpy(path, column="c_custkey")
    got = R.read_paths(s, path, "numpy").select(F.explode("data").alias("x"))
    return got.agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("sink_images", "SELECT s_name AS name, length(s_name) AS size FROM supplier")
def sink_images(s: SparkSession, d: str) -> DataFrame:
    """One file a row, named by a column, with the bytes of the row."""
    path = folder(s)
    df = read(s, d, "supplier").select("s_name", F.col("s_name").cast("binary").alias("content"))
    Frame(df).to_images(path, column="content", name="s_name", suffix="jpg")
    files = s.read.format("binaryFile").load(path)
    return files.select(F.col("content").cast("string").alias("name"), F.col("length").cast("int").alias("size"))


@query("sink_custom", "SELECT c_custkey, c_name FROM customer")
def sink_custom(s: SparkSession, d: str) -> DataFrame:
    W.register_custom_writer(".lines", lambda df, path, **o: df.write.options(sep=";").csv(path), "lines")
    path = f"{folder(s)}/out.lines"
    Frame(read(s, d, "customer")).select("c_custkey", "c_name").write(path)
    return s.read.options(sep=";").schema("c_custkey bigint, c_name string").csv(path)


@query("sink_pipeline", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def sink_pipeline(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    Frame(read(s, d, "customer")).to_pipeline(path, stages=[lambda df: df.filter("c_acctbal > 0")]).run()
    return s.read.parquet(path).select("c_custkey")
