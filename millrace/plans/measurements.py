"""Queries over measurement series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.spikes import BURST, FACTOR, STUCK, implausible_readings
from millrace.plans.catalog import query, read


def _burst(size: int, place: int) -> str:
    """Whether a reading is at `place` of a burst of `size` readings, by window functions over its series."""
    at = lambda k: "x" if k == 0 else f"lead(x, {k}) OVER s" if k > 0 else f"lag(x, {-k}) OVER s"
    inside = ", ".join(at(k) for k in range(-place, size - place))
    low, high = (f"least({inside})", f"greatest({inside})") if size > 1 else ("x", "x")
    left, right = at(-place - 1), at(size - place)
    there = f"{left} IS NOT NULL AND {right} IS NOT NULL AND {at(-place)} IS NOT NULL AND {at(size - place - 1)} IS NOT NULL"
    return f"coalesce({there} AND greatest({low} - greatest({left}, {right}), least({left}, {right}) - {high}) > {FACTOR} * scale, false)"


def _series_sql() -> str:
    bursts = " OR ".join(_burst(n, k) for n in range(1, BURST + 1) for k in range(n))

    def device(metric: str, high: str) -> str:
        return f"SELECT snapshot_id, worker_id, timestamp AS t, '{metric}', (i - 1)::INT, {metric}[i], {high} FROM resource_snapshot, unnest(range(1, coalesce(len({metric}), 0) + 1)) AS u(i)"

    return f"""WITH r AS (SELECT snapshot_id, worker_id, timestamp AS t, 'cpu_percent' AS metric, -1 AS device, cpu_percent AS x, 100.0 * cpu_count AS high FROM resource_snapshot
      UNION ALL {device('gpu_temperature', '120.0')} UNION ALL {device('gpu_memory_used_mb', 'gpu_memory_total_mb[i]')}),
    k AS (SELECT worker_id, t, metric, device, arg_min(x, snapshot_id) AS x, arg_min(high, snapshot_id) AS high FROM r WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2, 3, 4),
    d AS (SELECT *, x IS DISTINCT FROM lag(x) OVER s AS new, abs(x - lag(x) OVER s) AS detail FROM k WINDOW s AS (PARTITION BY worker_id, metric, device ORDER BY t)),
    g AS (SELECT *, sum(new::INT) OVER s AS run, median(detail) OVER p AS scale, count(*) OVER p AS n, count(*) OVER (PARTITION BY worker_id, metric, device, x) AS same FROM d
      WINDOW s AS (PARTITION BY worker_id, metric, device ORDER BY t), p AS (PARTITION BY worker_id, metric, device)),
    f AS (SELECT *, count(*) OVER (PARTITION BY worker_id, metric, device, run) AS length, max(same) OVER (PARTITION BY worker_id, metric, device) AS most, {bursts} AS burst FROM g
      WINDOW s AS (PARTITION BY worker_id, metric, device ORDER BY t))
    SELECT r.snapshot_id, f.metric, f.device FROM f JOIN (SELECT DISTINCT snapshot_id, worker_id, t FROM r) r USING (worker_id, t) WHERE f.x < 0 OR f.x > f.high OR (length >= {STUCK} AND 2 * most <= n) OR burst"""


@query("p1_found", _series_sql())
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(read(spark, sf_dir, "resource_snapshot"))
