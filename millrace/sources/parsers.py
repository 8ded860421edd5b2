"""Decoders of file formats that Spark has no reader for: bytes -> rows. Pure functions, run on executors.

Each has a schema; a decoder for which a library is missing raises and names it.
"""

from __future__ import annotations

import bz2
import io
import json
import sqlite3
import struct
import tarfile
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import Any

import numpy as np

Rows = Iterator[dict[str, Any]]


def unpacked(how: str, data: bytes) -> bytes:
    """A chunk of a bag."""
    if how in ("", "none"):
        return data
    if how == "bz2":
        return bz2.decompress(data)
    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if how == "lz4":
        import pyarrow as pa

        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    raise RuntimeError(f"chunks compressed by {how} need the package {how}")


def as_json(value: Any) -> str:
    def other(v: Any) -> Any:
        if isinstance(v, bytes):
            return v.hex()
        return v.tolist() if hasattr(v, "tolist") else str(v)

    return json.dumps(value, default=other, ensure_ascii=False)


ARCHIVE = "entry_name string, size bigint, compressed_size bigint, is_dir boolean, entry_index int, content binary, extract_error string"


def archive(data: bytes, path: str, extract: bool = True, max_size: int | None = None, pattern: str | None = None) -> Rows:
    """One row for each entry of a zip or tar(.gz/.bz2); with `max_size`, a larger entry has an extract_error instead of its content."""
    import fnmatch

    def row(i: int, name: str, size: int, packed: int | None, is_dir: bool, read: Any) -> dict[str, Any]:
        content = error = None
        if extract and not is_dir and max_size is not None and size > max_size:
            error = f"skipped: {size} bytes, max_size is {max_size}"
        elif extract and not is_dir:
            try:
                content = read()
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return {"entry_name": name, "size": size, "compressed_size": packed, "is_dir": is_dir, "entry_index": i, "content": content, "extract_error": error}

    wanted = lambda name: not pattern or fnmatch.fnmatch(name, pattern)
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i, e in enumerate(z.infolist()):
                if wanted(e.filename):
                    yield row(i, e.filename, e.file_size, e.compress_size, e.is_dir(), lambda e=e: z.read(e))
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for i, m in enumerate(t):
            if wanted(m.name):
                yield row(i, m.name, m.size, None, m.isdir(), lambda m=m: (t.extractfile(m) or io.BytesIO()).read())


BINARY = "record_index bigint, data array<double>, bytes binary"


def binary(data: bytes, path: str, struct_format: str | None = None, record_size: int | None = None) -> Rows:
    """Records of a struct format (numbers), of a fixed size (bytes), or the whole file. A short rest at the end is left out."""
    if struct_format:
        s = struct.Struct(struct_format)
        step = record_size or s.size
        for i in range(len(data) // step):
            values = s.unpack_from(data, i * step)
            yield {"record_index": i, "data": [float(v) for v in values if isinstance(v, (int, float))], "bytes": None}
    elif record_size:
        for i in range(len(data) // record_size):
            yield {"record_index": i, "data": None, "bytes": data[i * record_size : (i + 1) * record_size]}
    else:
        yield {"record_index": 0, "data": None, "bytes": data}


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


YAML = "config string"


def yaml_config(data: bytes, path: str) -> Rows:
    """The document as JSON."""
    import yaml

    yield {"config": as_json(yaml.safe_load(_text(data)))}


CALIBRATION = "calibration string"


def calibration(data: bytes, path: str) -> Rows:
    """Camera calibration of a yaml, json or xml file as JSON."""
    import yaml

    text = _text(data)
    if path.lower().endswith(".xml"):
        def tree(e: ET.Element) -> Any:
            kids = {k.tag: tree(k) for k in e}
            return kids | dict(e.attrib) if kids or e.attrib else (e.text or "").strip()

        yield {"calibration": as_json(tree(ET.fromstring(text)))}
    else:
        # opencv files start with a directive that yaml readers refuse
        yield {"calibration": as_json(yaml.safe_load("\n".join(x for x in text.splitlines() if not x.startswith("%YAML"))))}


MSGPACK = "data string"


def msgpack(data: bytes, path: str) -> Rows:
    """Each object of the stream as JSON."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the stream is cut off")
        at += n
        return data[at - n : at]

    num = lambda f: struct.unpack(">" + f, take(struct.calcsize(f)))[0]

    def value() -> Any:
        b = num("B")
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return {str(value()): value() for _ in range(b & 15)}
        if b < 0xA0:
            return [value() for _ in range(b & 15)]
        if b < 0xC0:
            return take(b & 31).decode()
        simple = {0xC0: None, 0xC2: False, 0xC3: True}
        if b in simple:
            return simple[b]
        sizes = "BHI"
        if 0xC4 <= b <= 0xC6:
            return take(num(sizes[b - 0xC4]))
        if 0xC7 <= b <= 0xC9:
            n, kind = num(sizes[b - 0xC7]), num("b")
            return {"type": kind, "data": take(n)}
        if 0xCA <= b <= 0xD3:
            return num("fdBHIQbhiq"[b - 0xCA])
        if 0xD4 <= b <= 0xD8:
            kind = num("b")
            return {"type": kind, "data": take(1 << (b - 0xD4))}
        if 0xD9 <= b <= 0xDB:
            return take(num(sizes[b - 0xD9])).decode()
        if b in (0xDC, 0xDD):
            return [value() for _ in range(num("HI"[b - 0xDC]))]
        if b in (0xDE, 0xDF):
            return {str(value()): value() for _ in range(num("HI"[b - 0xDE]))}
        raise ValueError(f"unknown type byte {b:#x}")

    while at < len(data):
        yield {"data": as_json(value())}


POINTS = "points array<array<double>>, colors array<array<double>>, normals array<array<double>>, num_points bigint, fields array<string>"
_PLY = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "i2", "ushort": "u2", "int16": "i2", "uint16": "u2", "int": "i4", "uint": "u4", "int32": "i4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def pointcloud(data: bytes, path: str, max_points: int | None = None, seed: int = 42) -> Rows:
    """Points, colours and normals of a pcd or ply file (ascii or binary), points and intensities of a LAS file; above `max_points`, if given, a seeded sample of them."""
    if data[:4] == b"LASF":
        yield _las(data, path, max_points, seed)
        return
    lines = io.BytesIO(data)
    fields: list[str] = []
    kinds: list[str] = []
    count, form = 0, "ascii"
    for raw in lines:
        word = raw.decode("latin-1").split()
        if not word or word[0] == "#":
            continue
        key = word[0].lower()
        if key == "format":
            form = word[1]
        elif key == "element":
            vertex = word[1] == "vertex"
            count = int(word[2]) if vertex else count
        elif key == "property" and vertex:
            kinds.append(_PLY[word[1]]), fields.append(word[2])
        elif key == "fields":
            fields = word[1:]
        elif key == "size":
            sizes = word[1:]
        elif key == "type":
            kinds = [f"{t.lower()}{n}" for t, n in zip(word[1:], sizes)]
        elif key == "points":
            count = int(word[1])
        elif key == "data":
            form = word[1]
            break
        elif key == "end_header":
            break
    rest = data[lines.tell() :]
    if form.startswith("binary"):
        if form == "binary_compressed":
            raise RuntimeError("compressed pcd files need the package open3d")
        kind = np.dtype([(f"{f}_{i}", (">" if "big" in form else "<") + k) for i, (f, k) in enumerate(zip(fields, kinds))])
        table = np.frombuffer(rest, kind, count=count)
        values = np.stack([table[n].astype(float) for n in kind.names], 1) if count else np.zeros((0, len(fields)))
    else:
        flat = [x.split() for x in rest.decode("latin-1").splitlines() if x.strip()][:count]
        values = np.array([[float(v) for v in row[: len(fields)]] for row in flat]).reshape(-1, len(fields))
    if max_points is not None and len(values) > max_points:
        values = values[np.sort(np.random.default_rng(seed).choice(len(values), max_points, replace=False))]

    def pick(*names: str) -> list | None:
        return values[:, [fields.index(n) for n in names]].tolist() if all(n in fields for n in names) else None

    yield {"points": pick("x", "y", "z"), "colors": pick("red", "green", "blue"), "normals": pick("nx", "ny", "nz") or pick("normal_x", "normal_y", "normal_z"), "num_points": len(values), "fields": fields}


def _las(data: bytes, path: str, max_points: int | None, seed: int) -> dict[str, Any]:
    """Uncompressed LAS 1.0 to 1.4: scaled coordinates; intensities in the place of colours, three times the same."""
    if path.lower().endswith(".laz") or data[104] & 0x80:
        raise RuntimeError("compressed LAS files need the package laspy")
    start, size, count = struct.unpack_from("<I", data, 96)[0], *struct.unpack_from("<HI", data, 105)
    if (data[24], data[25]) >= (1, 4) and not count:
        (count,) = struct.unpack_from("<Q", data, 247)
    scale, offset = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    raw = np.frombuffer(data, np.uint8, count * size, start).reshape(count, size)
    points = np.ascontiguousarray(raw[:, :12]).view("<i4").reshape(count, 3) * scale + offset
    intensity = np.ascontiguousarray(raw[:, 12:14]).view("<u2").astype(float).ravel()
    if max_points is not None and count > max_points:
        at = np.sort(np.random.default_rng(seed).choice(count, max_points, replace=False))
        points, intensity = points[at], intensity[at]
    return {"points": points.tolist(), "colors": np.stack([intensity] * 3, 1).tolist(), "normals": None, "num_points": len(points), "fields": ["x", "y", "z", "intensity"]}


PROTOBUF = "raw_data string, parse_error string"


def protobuf(data: bytes, path: str) -> Rows:
    """The bytes as hex; with a descriptor use read(..., descriptor=, message=), which decodes inside Spark."""
    yield {"raw_data": data.hex(), "parse_error": None}


MESSAGES = "topic string, timestamp double, timestamp_ns bigint, message struct<data: string, size: bigint>, type string, index bigint"


def _wanted(topic: str, ns: int, topics: list[str] | None, start: float | None, end: float | None) -> bool:
    return (not topics or topic in topics) and (start is None or ns >= start * 1e9) and (end is None or ns <= end * 1e9)


def _message(topic: str, ns: int, data: bytes, kind: str | None, index: int) -> dict[str, Any]:
    return {"topic": topic, "timestamp": ns / 1e9, "timestamp_ns": ns, "message": {"data": data.hex(), "size": len(data)}, "type": kind, "index": index}


def ros2bag(data: bytes, path: str, topics: list[str] | None = None, start: float | None = None, end: float | None = None) -> Rows:
    """Messages of a sqlite bag, by time; topic and time filters are part of the query on the bag."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    where, args = ["1 = 1"], []
    if topics:
        where.append(f"t.name IN ({', '.join('?' * len(topics))})"), args.extend(topics)
    if start is not None:
        where.append("m.timestamp >= ?"), args.append(int(start * 1e9))
    if end is not None:
        where.append("m.timestamp <= ?"), args.append(int(end * 1e9))
    sql = f"SELECT t.name, m.timestamp, m.data, t.type FROM messages m JOIN topics t ON m.topic_id = t.id WHERE {' AND '.join(where)} ORDER BY m.timestamp, m.id"
    for i, (topic, ns, body, kind) in enumerate(db.execute(sql, args)):
        yield _message(topic, ns, bytes(body), kind, i)
    db.close()


def rosbag(data: bytes, path: str, topics: list[str] | None = None, start: float | None = None, end: float | None = None) -> Rows:
    """Messages of a version 2.0 bag, with chunks stored plain, by bz2 or by lz4."""
    if not data.startswith(b"#ROSBAG V2.0\n"):
        raise ValueError("not a version 2.0 bag")
    names: dict[int, tuple[str, str | None]] = {}
    index = 0

    def header(raw: bytes) -> dict[str, bytes]:
        out, at = {}, 0
        while at < len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            key, _, value = raw[at + 4 : at + 4 + n].partition(b"=")
            out[key.decode()] = value
            at += 4 + n
        return out

    def records(raw: bytes, at: int = 0) -> Iterator[tuple[dict[str, bytes], bytes]]:
        while at + 8 <= len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            (m,) = struct.unpack_from("<I", raw, at + 4 + n)
            yield header(raw[at + 4 : at + 4 + n]), raw[at + 8 + n : at + 8 + n + m]
            at += 8 + n + m

    def walk(raw: bytes, at: int = 0) -> Iterator[tuple[str, int, bytes, str | None]]:
        for head, body in records(raw, at):
            op = head["op"][0]
            if op == 7:
                conn = struct.unpack("<I", head["conn"])[0]
                names[conn] = (head["topic"].decode(), header(body).get("type", b"").decode() or None)
            elif op == 2:
                secs, nsecs = struct.unpack("<II", head["time"])
                topic, kind = names[struct.unpack("<I", head["conn"])[0]]
                yield topic, secs * 10**9 + nsecs, body, kind
            elif op == 5:
                yield from walk(unpacked(head["compression"].decode(), body))

    for topic, ns, body, kind in walk(data, 13):
        if _wanted(topic, ns, topics, start, end):
            yield _message(topic, ns, body, kind, index)
            index += 1


def mcap(data: bytes, path: str, topics: list[str] | None = None, start: float | None = None, end: float | None = None, types: list[str] | None = None) -> Rows:
    """Messages of an MCAP file, filtered by topic, time and schema name; chunks stored plain, by zstd or by lz4."""
    if not data.startswith(b"\x89MCAP0\r\n"):
        raise ValueError("not an MCAP file")
    schemas: dict[int, str] = {}
    channels: dict[int, tuple[str, int]] = {}
    index = 0

    def text(raw: bytes, at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<I", raw, at)
        return raw[at + 4 : at + 4 + n].decode(), at + 4 + n

    def walk(raw: bytes, at: int) -> Iterator[tuple[str, int, bytes, str | None]]:
        while at + 9 <= len(raw):
            op, n = struct.unpack_from("<BQ", raw, at)
            body = raw[at + 9 : at + 9 + n]
            at += 9 + n
            if op == 3:
                schemas[struct.unpack_from("<H", body)[0]] = text(body, 2)[0]
            elif op == 4:
                number, schema = struct.unpack_from("<HH", body)
                channels[number] = (text(body, 4)[0], schema)
            elif op == 5:
                number, _, ns = struct.unpack_from("<HIQ", body)
                topic, schema = channels[number]
                yield topic, ns, body[22:], schemas.get(schema)
            elif op == 6:
                how, k = text(body, 28)
                (size,) = struct.unpack_from("<Q", body, k)
                yield from walk(unpacked(how, body[k + 8 : k + 8 + size]), 0)
            elif op in (2, 15):
                return

    for topic, ns, body, kind in walk(data, 8):
        if _wanted(topic, ns, topics, start, end) and (not types or kind in types):
            yield _message(topic, ns, body, kind, index)
            index += 1


_GEOMETRY = "struct<type: string, size: array<double>, radius: double, length: double, filename: string>"
URDF = f"robot_name string, links array<struct<name: string, geometry: {_GEOMETRY}>>, joints array<struct<name: string, type: string, parent: string, child: string, lower: double, upper: double, velocity: double>>, num_links int, num_joints int"


def urdf(data: bytes, path: str) -> Rows:
    """Links with their geometry (attributes or child elements) and joints with limits of a urdf or sdf file."""
    root = ET.fromstring(_text(data))
    model = root if root.tag == "robot" else root.find(".//model")
    model = root if model is None else model

    def get(e: ET.Element | None, name: str) -> str | None:
        if e is None:
            return None
        return e.get(name) or (e.findtext(name) or "").strip() or None

    number = lambda v: float(v) if v else None

    def geometry(link: ET.Element) -> dict[str, Any] | None:
        g = link.find(".//geometry")
        shape = next(iter(g), None) if g is not None else None
        if shape is None:
            return None
        size = get(shape, "size")
        return {"type": shape.tag, "size": [float(x) for x in size.split()] if size else None, "radius": number(get(shape, "radius")), "length": number(get(shape, "length")), "filename": get(shape, "filename") or get(shape, "uri")}

    def joint(j: ET.Element) -> dict[str, Any]:
        limit = j.find("limit") if j.find("limit") is not None else j.find(".//limit")
        end = lambda tag: (j.find(tag).get("link") or (j.find(tag).text or "").strip() or None) if j.find(tag) is not None else None
        return {"name": j.get("name"), "type": j.get("type"), "parent": end("parent"), "child": end("child"), "lower": number(get(limit, "lower")), "upper": number(get(limit, "upper")), "velocity": number(get(limit, "velocity"))}

    links, joints = [{"name": k.get("name"), "geometry": geometry(k)} for k in model.findall("link")], [joint(j) for j in model.findall("joint")]
    yield {"robot_name": model.get("name"), "links": links, "joints": joints, "num_links": len(links), "num_joints": len(joints)}


PACKETS = "index bigint, timestamp double, size bigint, data string"


def velodyne(data: bytes, path: str) -> Rows:
    """Packets of a pcap capture; any other file is one packet."""
    orders = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
    if data[:4] not in orders:
        yield {"index": 0, "timestamp": None, "size": len(data), "data": data.hex()}
        return
    order, unit = orders[data[:4]]
    at, i = 24, 0
    while at + 16 <= len(data):
        secs, part, n, _ = struct.unpack_from(order + "IIII", data, at)
        yield {"index": i, "timestamp": secs + part / unit, "size": n, "data": data[at + 16 : at + 16 + n].hex()}
        at += 16 + n
        i += 1


NUMPY = "name string, shape array<bigint>, dtype string, data array<double>"


def numpy_arrays(data: bytes, path: str) -> Rows:
    """One row for the array of an npy file, one for each of an npz; values flattened, numbers only."""
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    items = loaded.items() if hasattr(loaded, "items") else [("array", loaded)]
    for name, a in items:
        numbers = a.dtype.kind in "biuf"
        yield {"name": name, "shape": list(a.shape), "dtype": str(a.dtype), "data": a.astype(float).ravel().tolist() if numbers else None}


AUDIO = "sample_rate int, channels int, sample_width int, frames bigint, samples array<double>"


def audio(data: bytes, path: str) -> Rows:
    """Samples of a wav file in [-1, 1], channels interleaved."""
    if not path.lower().endswith(".wav"):
        raise RuntimeError("only wav files can be decoded without an audio package such as soundfile")
    with wave.open(io.BytesIO(data)) as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
        elif width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        else:
            x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
        yield {"sample_rate": w.getframerate(), "channels": w.getnchannels(), "sample_width": width, "frames": w.getnframes(), "samples": x.tolist()}


SQLITE = "table_name string, row_index bigint, row string"


def sqlite_tables(data: bytes, path: str, table: str | None = None) -> Rows:
    """Rows of all tables (or one) as JSON."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    names = [n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    for name in names:
        if table in (None, name):
            quoted = name.replace('"', '""')
            rows = db.execute(f'SELECT * FROM "{quoted}"')
            columns = [c[0] for c in rows.description]
            for i, r in enumerate(rows):
                yield {"table_name": name, "row_index": i, "row": as_json(dict(zip(columns, r)))}
    db.close()


TFRECORD = "record_index bigint, features string, raw binary"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def proto_fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """(field, wire type, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, wire, value


def example_features(data: bytes) -> dict[str, list]:
    """The features of an Example message: name -> values (bytes, floats or integers)."""
    out: dict[str, list] = {}
    for _, _, features in proto_fields(data):
        for _, _, entry in proto_fields(features):
            parts = {f: v for f, _, v in proto_fields(entry)}
            values: list = []
            for kind, _, packed in proto_fields(parts.get(2, b"")):
                for _, wire, v in proto_fields(packed):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif wire == 0:
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            values.append(x - (1 << 64) if x >> 63 else x)
            out[parts[1].decode()] = values
    return out


def tfrecord(data: bytes, path: str) -> Rows:
    """Records with the features of Example messages as JSON (bytes as text where they are UTF-8, else hex)."""
    at = i = 0
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        body = data[at + 12 : at + 12 + n]
        if len(body) < n:
            raise ValueError("the file is cut off")

        def plain(v: Any) -> Any:
            if isinstance(v, bytes):
                try:
                    return v.decode()
                except UnicodeDecodeError:
                    return v.hex()
            return v

        try:
            features = as_json({k: [plain(v) for v in vs] for k, vs in example_features(body).items()})
        except Exception:
            features = None
        yield {"record_index": i, "features": features, "raw": body}
        at += 16 + n
        i += 1
