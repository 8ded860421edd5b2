import random

import numpy as np
import pytest

from millrace.operators.spikes import coefficients, implausible, implausible_readings, majority, margins, runs, weighted_median

SCHEMA = (
    "snapshot_id bigint, worker_id string, timestamp double, cpu_percent double, cpu_count int, "
    "gpu_memory_used_mb array<double>, gpu_memory_total_mb array<double>, gpu_temperature array<double>"
)


def brute_series(x):
    n, bad = len(x), set()
    m = np.median(np.abs(np.diff(x))) if n > 1 else 0
    most = max((sum(1 for v in x if v == u) for u in set(x)), default=0)
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            j += 1
        if j - i >= 12 and 2 * most <= n:
            bad |= set(range(i, j))
        i = j
    for size in (1, 2, 3):
        for i in range(1, n - size):
            b, a, c = x[i : i + size], x[i - 1], x[i + size]
            if min(b) - max(a, c) > 12 * m or min(a, c) - max(b) > 12 * m:
                bad |= set(range(i, i + size))
    return bad


def brute(rows):
    out = set()
    for w in {r[1] for r in rows}:
        mine, copies = {}, {}
        for r in sorted(r for r in rows if r[1] == w):
            mine.setdefault(r[2], r)
            copies.setdefault(r[2], []).append(r[0])
        order = sorted(mine)
        for metric, dev, value, high in [("cpu_percent", -1, lambda r: r[3], lambda r: 100 * r[4])] + [
            (m, d, lambda r, c=c, d=d: r[c][d] if r[c] is not None and d < len(r[c]) else None, (lambda r: 120.0) if c == 7 else (lambda r, d=d: r[6][d]))
            for m, c in (("gpu_memory_used_mb", 5), ("gpu_temperature", 7)) for d in range(3)
        ]:
            s = [(t, value(mine[t]), mine[t]) for t in order]
            s = [(t, v, r) for t, v, r in s if v is not None and v == v]
            bad = {s[i][0] for i in brute_series([v for _, v, _ in s])} if s else set()
            bad |= {t for t, v, r in s if v < 0 or v > high(r)}
            out |= {(i, metric, dev) for t in bad for i in copies[t]}
    return out


def series(rng, n, k):
    level, out = 50.0, []
    while len(out) < n:
        p = rng.random()
        if p < 0.02:
            level += rng.choice([-20, 20])
        if p < 0.03:
            out += [round(level, 1)] * rng.randrange(9, 16)
        elif p < 0.05:
            out += [level + rng.choice([-60.0, 60.0])] * rng.randrange(1, 5)
        elif p < 0.07:
            out.append(rng.choice([float("nan"), None, -1.0, 500.0, 1e6]))
        else:
            out.append(level if k == 2 else round(level + rng.gauss(0, 1), 1))
    return out[:n]


def table(seed, sizes):
    rng, rows, at = random.Random(seed), [], 1
    for w, n in enumerate(sizes):
        cols = [series(rng, n, k) for k in range(5)]
        for i in range(n):
            arrays = rng.random() > 0.03
            used, temp = ([cols[1][i], cols[2][i]], [cols[3][i], cols[4][i]]) if arrays else (None, rng.choice([None, []]))
            row = (at, f"w{w}", float(i), cols[0][i], 2, used, [100.0, 100.0, 100.0], temp)
            rows.append(row)
            at += 1
            if rng.random() < 0.03:
                rows.append((at, *row[1:]))
                at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,sizes,blocks,fan", [(1, [400, 60, 5], 1, 1000), (2, [700, 30, 30], 9, 1000), (3, [300, 1, 2, 200, 13], 40, 1000), (2, [700, 30, 30], 9, 2), (3, [300, 1, 2, 200, 13], 40, 3)])
def test_against_brute_force(spark, seed, sizes, blocks, fan):
    rows = table(seed, sizes)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as metric", "1 as device", "2 as w")
    got = [tuple(r) for r in implausible_readings(df, blocks=blocks, fan=fan).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_edges(spark):
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [
        (1, None, 1.0, 5000.0, 1, None, None, None), (2, "a", None, -1.0, 1, [5.0], [4.0], [130.0, None]), (3, "a", float("nan"), 1.0, None, [1.0], None, [1.0]),
        (None, "a", 1.0, -5.0, 1, None, None, None), (5, "a", 2.0, 1.0, None, [float("inf")], [4.0], []),
    ]
    got = sorted(map(tuple, implausible_readings(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(1, "cpu_percent", -1), (2, "cpu_percent", -1), (2, "gpu_memory_used_mb", 0), (2, "gpu_temperature", 0), (5, "gpu_memory_used_mb", 0)]


def test_hot_group_of_copies(spark):
    rows = [(i, "a", 5.0, 900.0, 1, None, None, None) for i in range(400)] + [(1000 + i, "a", 10.0 + i, float(i % 3), 1, None, None, None) for i in range(50)]
    assert implausible_readings(spark.createDataFrame(rows, SCHEMA), blocks=4).count() == 400


def test_parts():
    assert runs(np.array([1.0] * 12 + [2.0] * 11)).sum() == 12
    assert margins(np.array([0, 5, 6, 0, 1.0])).tolist() == [0, 5, 5, 1, 0]
    assert majority(np.array([1, 1, 2.0])) and not majority(np.array([1, 1, 2, 3.0])) and not majority(np.array([]))
    assert not implausible(np.array([1.0, 2.0])).any()


def test_bursts_are_made_by_coefficients_of_their_scales():
    d = coefficients(np.array([0.0, 9, 8, 7, 1]))
    assert [c.tolist() for c in d] == [[0, 9, -1, -1, -6], [0, 0, 8, -2, -7], [0, 0, 0, 7, -8]]
    # opened by 9, 8, 7 and closed by 6, 7, 8: a burst up to a threshold of 6
    assert margins(np.array([0.0, 9, 8, 7, 1])).tolist() == [0, 6, 6, 6, 0]
    assert margins(np.array([0.0, 9, 8, 7, 1]), longest=2).tolist() == [0, 1, 1, 0, 0]


def test_weighted_median(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.choice([0.0, 0.1, 2.5, 1e6]) * rng.random(), 3), rng.randrange(1, 5)) for k in range(5) for _ in range(41)]
    got = {r.k: r["median"] for r in weighted_median(spark.createDataFrame(rows, "k int, x double, n int"), ["k"], "x", "n").collect()}
    for k in range(5):
        assert got[k] == np.median(np.repeat([r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k]))
