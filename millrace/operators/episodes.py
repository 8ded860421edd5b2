"""Trajectories: episodes, transitions, time alignment, resampling, teleoperation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.records import extract_field

# Reference clocks, best first.
CLOCKS = ("simulation", "episode", "step", "wall_clock")


def detect_episodes(df: DataFrame) -> DataFrame:
    """Add episode_id, step and is_episode_start from the first of the usual names that is present."""
    first = lambda names, default: F.coalesce(*[extract_field(df, n) for n in names], F.lit(default))
    episode = F.coalesce(*[extract_field(df, n).cast("string") for n in ("episode_id", "episode", "trajectory_id")], F.lit("unknown"))
    step = first(("step", "timestep", "t"), 0).cast("long")
    return df.withColumns({"episode_id": episode, "step": step}).withColumn("is_episode_start", F.col("step") == 0)


def episode_bounds(df: DataFrame, episode: str, step: str | list[str], min_length: int = 1, max_length: int | None = None) -> DataFrame:
    """Drop episodes shorter than `min_length`, cut longer ones to their first `max_length` rows, mark the last row.

    The length of each episode comes from the same window partitioning as the numbering: one shuffle.
    """
    w = Window.partitionBy(episode)
    order = [step] if isinstance(step, str) else step
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order))).filter(F.col("_n") >= min_length)
    if max_length:
        out = out.filter(F.col("_k") <= max_length)
    last = F.least("_n", F.lit(max_length)) if max_length else F.col("_n")
    return out.withColumn("episode_step", F.col("_k") - 1).withColumn("is_episode_end", F.col("_k") == last).drop("_n", "_k")


def episode_statistics(df: DataFrame, episode: str, step: str) -> DataFrame:
    """(episodes, avg_length, min_length, max_length); a length is last step - first step + 1."""
    per = df.groupBy(episode).agg((F.max(step) - F.min(step) + 1).alias("n"))
    return per.agg(F.count("*").alias("episodes"), F.avg("n").alias("avg_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))


def transitions(
    df: DataFrame, episode: str, step: str | list[str], state: str, action: str, reward: str | None = None, missing: str = "skip",
) -> DataFrame:
    """(episode, step, state, action, reward, next_state, done): each row with the next of its episode; the last row of an episode starts none.

    missing: 'skip' drops transitions with a null state, action or next state; 'zero' keeps them as they are, with reward 0.
    """
    order = [step] if isinstance(step, str) else step
    w = Window.partitionBy(episode).orderBy(*order)
    r = F.col(reward).cast("double") if reward else F.lit(0.0)
    out = df.select(
        F.col(episode).alias("episode_id"), F.col(order[0]).alias("step"), F.col(state).alias("state"), F.col(action).alias("action"), F.coalesce(r, F.lit(0.0)).alias("reward"),
        F.lead(F.struct(F.col(state).alias("s"))).over(w).alias("_next"), F.lead(F.lit(1), 2).over(w).isNull().alias("done"),
    ).filter("_next is not null").withColumn("next_state", F.col("_next.s")).drop("_next")
    return out.filter("state is not null and action is not null and next_state is not null") if missing == "skip" else out


def validate_transitions(df: DataFrame) -> DataFrame:
    """transition_valid: states of one length and a reward that is a number."""
    return df.withColumn("transition_valid", (F.size("state") == F.size("next_state")) & F.col("reward").isNotNull() & ~F.isnan("reward"))


def align_times(df: DataFrame, clocks: dict[str, str], max_gap: float = 1.0, rate: float | None = None) -> DataFrame:
    """Times of several modalities relative to the best clock present.

    clocks: name -> column. Adds time_reference, aligned_times (map), temporal_consistent (gap of neighbours at most
    `max_gap`) and, with `rate`, resampled_timestamps. Rows without any time get nulls and count as consistent.
    """
    order = [*[c for c in CLOCKS if c in clocks], *[c for c in clocks if c not in CLOCKS]]
    reference = F.coalesce(*[F.col(clocks[c]).cast("double") for c in order])
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), (F.col(clocks[c]).cast("double") - reference).alias("v")) for c in clocks]), lambda e: e.v.isNotNull())
    out = df.withColumn("time_reference", reference).withColumn("_e", entries)
    times = F.array_sort(F.transform("_e", lambda e: e.v))
    gaps = F.transform(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda x, i: x - F.get("_t", i))
    out = out.withColumn("aligned_times", F.map_from_entries("_e")).withColumn("_t", times)
    out = out.withColumn("temporal_consistent", F.coalesce(F.array_max(gaps) <= max_gap, F.lit(True)))
    if rate:
        span = F.array_max("_t") - F.array_min("_t")
        points = F.sequence(F.lit(0), F.floor(span * rate + 1e-9).cast("int"))
        out = out.withColumn("resampled_timestamps", F.when(F.size("_t") > 0, F.transform(points, lambda i: F.array_min("_t") + i / rate)))
    return out.drop("_e", "_t")


def dropout(df: DataFrame, modalities: dict[str, list[str]], rate: float = 0.1, keep_at_least: int = 1, seed: int = 42, key: str | None = None) -> DataFrame:
    """Null the fields of each modality with probability `rate`, fixed by seed and row, keeping at least so many modalities.

    Adds dropped_modalities, remaining_modalities, has_missing_modalities and modality_dropout_applied.
    """
    from millrace.functions.hashing import row_key, uniform
    from millrace.functions.records import present

    ident = F.col(key) if key else row_key(df)
    out = df.withColumn("_k", ident)
    left = sum((present(df, *cols).cast("int") for cols in modalities.values()), F.lit(0))
    out = out.withColumn("_left", left)
    for m, cols in modalities.items():
        go = present(df, *cols) & (uniform(seed, F.lit(m), "_k") < rate) & (F.col("_left") > keep_at_least)
        out = out.withColumn(f"_drop_{m}", go).withColumn("_left", F.col("_left") - F.col(f"_drop_{m}").cast("int"))
    had = {m: present(df, *cols) for m, cols in modalities.items()}
    out = out.withColumn("dropped_modalities", F.array_compact(F.array(*[F.when(F.col(f"_drop_{m}"), F.lit(m)) for m in modalities])))
    out = out.withColumn("remaining_modalities", F.array_compact(F.array(*[F.when(had[m] & ~F.col(f"_drop_{m}"), F.lit(m)) for m in modalities])))
    nulled = {c: F.when(~F.col(f"_drop_{m}"), F.col(c)) for m, cols in modalities.items() for c in cols if c in df.columns}
    out = out.withColumns(nulled).withColumn("has_missing_modalities", F.size("dropped_modalities") > 0).withColumn("modality_dropout_applied", F.lit(True))
    return out.drop("_k", "_left", *[f"_drop_{m}" for m in modalities])


def normalize_sequences(df: DataFrame, columns: list[str], target: int | None = None, most: int | None = None, truncate: str = "end", pad: str = "zero") -> DataFrame:
    """Bring arrays to one length: `target`, else the longest of the table, at most `most`. Adds four columns of bookkeeping a field."""
    from millrace.functions.arrays import fit_length

    out = df
    if target is None:
        longest = df.agg(F.max(F.greatest(*[F.size(c) for c in columns], F.lit(0)))).first()[0] or 0
        target = min(longest, most) if most else longest
    for c in columns:
        n = F.size(c)
        out = out.withColumns({f"{c}_original_length": n, f"{c}_normalized_length": F.lit(target), f"{c}_was_padded": n < target, f"{c}_was_truncated": n > target})
        out = out.withColumn(c, fit_length(F.col(c), target, truncate, pad))
    return out


def sync_views(df: DataFrame, views: Column | str) -> DataFrame:
    """Base time (the earliest view) and each view's offset to it; `views` is an array of structs with a timestamp."""
    v = F.col(views) if isinstance(views, str) else views
    base = F.array_min(F.transform(v, lambda x: x.timestamp))
    return df.withColumn("base_timestamp", base).withColumn("view_offsets", F.transform(v, lambda x: x.timestamp - F.col("base_timestamp")))


def segment(df: DataFrame, boundaries: str, shortest: float = 1.0, longest: float = 60.0) -> DataFrame:
    """One row for each pair of successive task boundaries that is `shortest` to `longest` seconds apart (segment_start, segment_end)."""
    b = F.array_sort(boundaries)
    pairs = F.transform(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("segment_start"), F.get(b, i + 1).alias("segment_end")))
    out = df.withColumn("_s", F.explode(pairs)).select(*df.columns, "_s.*")
    length = F.col("segment_end") - F.col("segment_start")
    return out.filter((length >= shortest) & (length <= longest))


def retarget(df: DataFrame, joints: int, name: str = "robot_actions") -> DataFrame:
    """Zero joint commands, a placeholder for a learned retargeting."""
    return df.withColumn(name, F.array_repeat(F.lit(0.0), joints))
