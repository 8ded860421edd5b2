import bz2
import io
import json
import sqlite3
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
import zstandard

from millrace.frame import Frame
from millrace.sources import parsers as P
from millrace.sources import registry as R
from millrace.sources import robotics
from millrace.sources import writers as W


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(spark, path, **options):
    return R.read_paths(spark, path, **options).collect()


def test_detection():
    for name, want in (("a.tar.gz", "archive"), ("a.PARQUET", "parquet"), ("x.tsv", "tsv"), ("calib_left.yaml", "calibration"), ("imu_dump", "csv"), ("a.yaml", "yaml"), ("what", "bytes"), ("r.db3", "ros2bag")):
        assert R.detect_format(f"/data/{name}") == want
    assert W.detect_writer("/out/x.csv") == "csv" and W.detect_writer("/out") == "parquet" and W.detect_writer("/json/out") == "json" and W.detect_writer("x", "jsonl") == "json"
    with pytest.raises(RuntimeError, match="h5py"):
        R.get_reader("hdf5")
    with pytest.raises(ValueError):
        R.get_reader("nope")
    assert "parquet" in R.list_formats()["native"] and "mcap" in R.list_formats()["decoded"] and "images" in W.list_formats()["native"]


def test_archives(spark, tmp_path):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("file1.txt", "one"), f.writestr("subdir/file3.txt", "three")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("a.bin")
        info.size = 4
        f.addfile(info, io.BytesIO(b"abcd"))
    got = {r.entry_name: bytes(r.content) for r in rows(spark, [put(tmp_path, "a.zip", z.getvalue()), put(tmp_path, "b.tar.gz", t.getvalue())])}
    assert got == {"file1.txt": b"one", "subdir/file3.txt": b"three", "a.bin": b"abcd"}
    assert [r["entry_name"] for r in P.archive(z.getvalue(), "a.zip", pattern="sub*")] == ["subdir/file3.txt"]


def test_binary(spark, tmp_path):
    path = put(tmp_path, "d.bin", b"".join(struct.pack("<fif", i, 2 * i, 0.5) for i in range(10)) + b"rest")
    got = R.read_paths(spark, path, struct_format="<fif").orderBy("record_index").collect()
    assert len(got) == 10 and got[3].data == [3.0, 6.0, 0.5]
    assert R.read_paths(spark, path, record_size=12).count() == 10 and bytes(rows(spark, path)[0].bytes).endswith(b"rest")


def test_text_configs(spark, tmp_path):
    assert json.loads(rows(spark, put(tmp_path, "c.yaml", "robot_name: r\njoints:\n- {name: j, limits: [0, 1]}\n"))[0].config)["joints"][0]["limits"] == [0, 1]
    assert json.loads(rows(spark, put(tmp_path, "calibration.yaml", "%YAML:1.0\ncamera_matrix: [[1, 0], [0, 1]]"))[0].calibration)["camera_matrix"] == [[1, 0], [0, 1]]
    assert json.loads(rows(spark, put(tmp_path, "calib.xml", "<c><k>5</k></c>"))[0].calibration) == {"k": "5"}
    attr = '<robot name="r"><link name="a"><visual><geometry><box size="1 2 3"/></geometry></visual></link><link name="b"><collision><geometry><cylinder><radius>0.5</radius></cylinder></geometry></collision></link><joint name="j" type="revolute"><parent link="a"/><child link="b"/><limit lower="-1" upper="1" velocity="2"/></joint></robot>'
    u = rows(spark, put(tmp_path, "r.urdf", attr))[0]
    assert u.num_links == 2 and u.links[0].geometry.size == [1, 2, 3] and u.links[1].geometry.radius == 0.5 and (u.joints[0].parent, u.joints[0].upper) == ("a", 1)
    bad = R.read_paths(spark, put(tmp_path, "bad.yaml", "a: [1"), format="yaml", on_error="column").first()
    assert bad.config is None and bad.read_error


def test_msgpack():
    data = b"\x83\xa1a\x01\xa1b\x93\xc0\xc3\xcb" + struct.pack(">d", 1.5) + b"\xa1c\xd1\xff\x00" + b"\xc4\x02\x01\x02" + b"\xff"
    assert [json.loads(r["data"]) for r in P.msgpack(data, "")] == [{"a": 1, "b": [None, True, 1.5], "c": -256}, "0102", -1]
    with pytest.raises(ValueError):
        list(P.msgpack(b"\x92\x01", ""))


def test_pointclouds():
    ply = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 255 0 0\n4 5 6 0 255 0\n"
    r = next(P.pointcloud(ply, "a.ply"))
    assert r["points"] == [[1, 2, 3], [4, 5, 6]] and r["colors"][0] == [255, 0, 0] and r["normals"] is None
    head = b"# .PCD\nVERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA binary\n"
    pcd = head + np.arange(9, dtype="<f4").tobytes()
    assert next(P.pointcloud(pcd, "a.pcd"))["points"][2] == [6, 7, 8] and next(P.pointcloud(pcd, "a.pcd", max_points=2))["num_points"] == 2


def test_bags(tmp_path):
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE topics(id INTEGER, name TEXT, type TEXT); CREATE TABLE messages(id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB);")
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/imu", "Imu"), (2, "/cam", "Image")])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, 1 + i % 2, i * 10**9, bytes([i])) for i in range(6)])
    raw = db.serialize()
    assert [r["timestamp"] for r in P.ros2bag(raw, "", topics=["/imu"], start=2)] == [2.0, 4.0]
    assert [json.loads(r["row"])["name"] for r in P.sqlite_tables(raw, "", table="topics")] == ["/imu", "/cam"]

    def record(head, body):
        h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v for k, v in head.items())
        return struct.pack("<I", len(h)) + h + struct.pack("<I", len(body)) + body

    conn = struct.pack("<I", 0)
    inner = record({b"op": b"\x07", b"conn": conn, b"topic": b"/imu"}, struct.pack("<I", 8) + b"type=Imu")
    inner += record({b"op": b"\x02", b"conn": conn, b"time": struct.pack("<II", 5, 7)}, b"\x01\x02")
    bag = b"#ROSBAG V2.0\n" + record({b"op": b"\x03"}, b"") + record({b"op": b"\x05", b"compression": b"bz2", b"size": conn}, bz2.compress(inner))
    got = list(P.rosbag(bag, ""))
    assert len(got) == 1 and got[0]["timestamp_ns"] == 5 * 10**9 + 7 and got[0]["message"]["data"] == "0102" and got[0]["type"] == "Imu"
    assert not list(P.rosbag(bag, "", topics=["/x"]))


def test_mcap():
    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    op = lambda k, body: struct.pack("<BQ", k, len(body)) + body
    inner = op(3, struct.pack("<H", 1) + text("Imu") + text("ros2") + struct.pack("<I", 0)) + op(4, struct.pack("<HH", 7, 1) + text("/imu") + text("cdr") + struct.pack("<I", 0))
    inner += b"".join(op(5, struct.pack("<HIQQ", 7, i, i * 10**9, 0) + bytes([i])) for i in range(4))
    packed = zstandard.ZstdCompressor().compress(inner)
    chunk = struct.pack("<QQQI", 0, 0, len(inner), 0) + text("zstd") + struct.pack("<Q", len(packed)) + packed
    data = b"\x89MCAP0\r\n" + op(1, text("") + text("")) + op(6, chunk) + op(15, b"\0" * 4)
    assert [(r["timestamp"], r["message"]["data"]) for r in P.mcap(data, "", topics=["/imu"], start=1, end=2)] == [(1.0, "01"), (2.0, "02")]
    assert not list(P.mcap(data, "", types=["Image"]))


def test_arrays_audio_packets(tmp_path, spark):
    out = io.BytesIO()
    np.savez(out, features=np.arange(6).reshape(2, 3), names=np.array(["a", "b"]))
    got = {r.name: r for r in rows(spark, put(tmp_path, "x.npz", out.getvalue()))}
    assert got["features"].shape == [2, 3] and got["features"].data == [0, 1, 2, 3, 4, 5] and got["names"].data is None
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(struct.pack("<3h", 0, 16384, -32768))
    assert next(P.audio(w.getvalue(), "a.wav"))["samples"] == [0, 0.5, -1.0]
    pcap = b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + struct.pack("<IIII", 3, 500000, 2, 2) + b"\x0a\x0b"
    assert next(P.velodyne(pcap, ""))["timestamp"] == 3.5 and next(P.velodyne(b"\1\2", ""))["data"] == "0102"
    assert next(P.protobuf(b"\x08\x01", ""))["raw_data"] == "0801"


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 1.5, [1, -2], None), (2, "b", -0.5, [], "x")], "i bigint, s string, d double, a array<bigint>, n string")
    f = Frame(df)
    for name in ("o.parquet", "o.json", "o.csv"):
        f.write(str(tmp_path / name))
        assert Frame.from_paths(spark, str(tmp_path / name)).count() == 2
    f.to_tfrecords(str(tmp_path / "o.tfrecord"))
    got = {json.loads(r.features)["i"][0]: json.loads(r.features) for r in rows(spark, str(tmp_path / "o.tfrecord"))}
    assert got[1]["s"] == ["é"] and got[1]["a"] == [1, -2] and got[2]["d"] == [-0.5] and "n" not in got[1] and got[2]["n"] == ["x"]
    f.drop("a").repartition(1).to_numpy(str(tmp_path / "np"))
    assert np.load(next((tmp_path / "np").glob("*.npy")))["i"].tolist() in ([1, 2], [2, 1])
    Frame(spark.createDataFrame([("p1", bytearray(b"PNG"))], "n string, content binary")).to_images(str(tmp_path / "img"), name="n")
    assert (tmp_path / "img" / "p1.png").read_bytes() == b"PNG"
    assert W.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    url = f"sqlite:///{tmp_path}/x.db"
    W.write_sql(df.select("i", "s"), url, "t")
    assert R.read_sql(spark, url, table="t").count() == 2
    W.write_output(df, str(tmp_path / "parts"), ["n"])
    assert (tmp_path / "parts" / "n=unknown").exists()


def test_custom_and_fallback(spark, tmp_path):
    R.register_custom_reader(".weird", lambda s, paths, **o: s.range(len(paths)))
    assert R.read_paths(spark, put(tmp_path, "a.weird", "x")).count() == 1
    W.register_custom_writer(".weird", lambda df, path, **o: put(tmp_path, "b.txt", str(df.count())))
    Frame(spark.range(3)).write(str(tmp_path / "c.weird"))
    assert (tmp_path / "b.txt").read_text() == "3"
    with pytest.raises(ValueError):
        R.read_paths(spark, [])
    tagged = R.load(spark, put(tmp_path, "t.jsonl", '{"text": "a"}\n{"text": null}\n')).collect()
    assert {r.data_type for r in tagged} == {"text"} and sorted(r.is_corrupted for r in tagged) == [False, True]


def test_robotics(spark, tmp_path):
    lines = [{"episode_id": "e1", "robot_id": "r", "task_id": "t", "data_type": "sensor", "sensor_data": {"joint_positions": [1.0]}}, {"episode_id": " ", "data_type": "sensor"}, {"episode_id": "e2", "data_type": "odd"}]
    put(tmp_path, "g/deep/x.jsonl", "\n".join(map(json.dumps, lines)))
    assert [r.groot_metadata.episode_id for r in robotics.read_trajectories(spark, str(tmp_path / "g")).collect()] == ["e1"]
    assert robotics.read_trajectories(spark, str(tmp_path / "g"), validate=False).count() == 3
    spark.createDataFrame([(1, [0.5, 1.0])], "step int, observations array<double>").write.parquet(str(tmp_path / "sim/a"))
    sim = robotics.read_simulation(spark, str(tmp_path / "sim"))
    assert sim.first().sensor_data.observations == [0.5, 1.0] and sim.first().robot_id == "robot"
    assert robotics.observation_space(spark.read.parquet(str(tmp_path / "sim/a")))["observations"]["shape"] == 2
    put(tmp_path, "v/a.mp4", b"xx"), put(tmp_path, "v/b.mp4", b"y"), put(tmp_path, "v/a.json", json.dumps({"resolution": [256, 256], "num_frames": 40, "generation_params": {"seed": 3}}))
    got = {r.length: (r.quality_score, r.gen_seed) for r in robotics.read_generated_videos(spark, str(tmp_path / "v")).collect()}
    assert got == {2: (1.0, "3"), 1: (None, None)}
    put(tmp_path, "r/depth_0003.npy", b"d"), put(tmp_path, "r/rgb_0003.png", b"p")
    assert {(r.kind, r.frame) for r in robotics.read_rendered(spark, str(tmp_path / "r")).collect()} == {("depth", "0003"), ("image", "0003")}
