"""Files beyond the reference's limits are read whole unless a limit is asked for."""

import io
import zipfile

import numpy as np

from millrace.sources import parsers as P


def test_large_archive_entry():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.bin", bytes((10 << 20) + 1))
    row = next(P.archive(made.getvalue(), "a.zip"))
    assert len(row["content"]) == row["size"] == (10 << 20) + 1 and row["extract_error"] is None
    row = next(P.archive(made.getvalue(), "a.zip", max_size=100))
    assert row["content"] is None and "max_size is 100" in row["extract_error"]


def test_large_pointcloud():
    n = 1_000_001
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    data = head.encode() + np.zeros((n, 3), "<f4").tobytes()
    row = next(P.pointcloud(data, "a.ply"))
    assert row["num_points"] == len(row["points"]) == n
    assert next(P.pointcloud(data, "a.ply", max_points=10))["num_points"] == 10
