"""Preparing training sets: splits, padding and masks, batches, synthetic records and environments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions.hashing import md5_mod, row_key, uniform
from millrace.operators.order import with_row_index

#: Patterns of synthetic texts by type, and the words that fill them.
PATTERNS = {
    "instruction": ("Take the {thing} off the {spot}.", "With the {side} arm, set the {thing} down at the {spot}.", "Bring the {thing} from the {spot} to the {goal}."),
    "description": ("An arm is {doing} a {thing} near the {spot}.", "Two arms are {doing} the {thing} between {spot} and {goal}.", "Recording of {job} with a {thing}."),
    "annotation": ("job={job}; thing={thing}; spot={spot}", "doing={doing}; thing={thing}", "{thing} at {goal}"),
}
WORDS = {
    "thing": ("gasket", "tray", "cable drum", "bearing", "vial", "bracket", "sensor cap", "crate"), "spot": ("conveyor", "bench", "feeder", "pallet", "cell door"),
    "goal": ("scanner", "outlet", "buffer lane", "test rig"), "side": ("left", "right"), "doing": ("lifting", "turning", "sorting", "stacking", "inspecting"), "job": ("kitting", "palletising", "inspection", "refilling"),
}
#: Ranges of randomized parameters, and the spread of the normal ones, by group.
RANGES = {
    "visual": {"lighting_intensity": (0.5, 2.0), "lighting_color": (0.8, 1.2), "texture_scale": (0.5, 2.0), "background_color": (0.0, 1.0)},
    "physical": {"friction": (0.1, 2.0), "mass_scale": (0.5, 2.0), "damping": (0.0, 0.1), "gravity_scale": (0.8, 1.2)},
    "geometric": {"size_scale": (0.8, 1.2), "position_noise": 0.05, "orientation_noise": 0.1},
    "sensor": {"camera_noise": 0.01, "calibration_error": (-0.05, 0.05), "imu_noise": 0.001},
    "dynamics": {"actuator_delay": (0.0, 0.02), "joint_limit_noise": 0.05, "compliance": (0.0, 0.1)},
}


def train_split(df: DataFrame, train_share: float = 0.9, key: str | None = None) -> DataFrame:
    """Add `split` (train or val) by the md5 of the episode, else the path, else the row, so an episode is never torn."""
    names = [key] if key else [c for c in ("episode_id", "path") if c in df.columns]
    value = F.coalesce(*[F.col(c).cast("string") for c in names], row_key(df))
    return df.withColumn("split", F.when(md5_mod(value, 100) / 100 < train_share, "train").otherwise("val"))


def write_splits(df: DataFrame, path: str, train_share: float = 0.9, seed: int = 42) -> None:
    """Shuffled train and val folders."""
    out = train_split(df, train_share)
    out.repartition("split", F.pmod(F.xxhash64(F.lit(seed), row_key(df)), F.lit(64))).sortWithinPartitions(F.rand(seed)).write.mode("overwrite").partitionBy("split").parquet(path)


def pack_sequences(df: DataFrame, columns: list[str], length: int = 2048) -> DataFrame:
    """Each list cut or padded to `length`, with a 0/1 mask <column>_mask."""
    masks = {f"{c}_mask": A.length_mask(F.col(c), length) for c in columns}
    return df.withColumns(masks).withColumns({c: A.fit_length(F.col(c), length) for c in columns})


def attention_masks(df: DataFrame, column: str, kind: str = "causal", name: str = "attention_mask") -> DataFrame:
    """Square mask over the length of `column`: causal is lower triangular, full and cross_modal are all ones."""
    if kind not in ("causal", "full", "cross_modal"):
        raise ValueError(f"unknown mask {kind}")
    return df.withColumn(name, A.attention_mask(F.size(column), kind == "causal"))


def batches(df: DataFrame, size: int = 32) -> Iterator[pd.DataFrame]:
    """Pandas batches on the driver, a partition at a time."""
    held: list[dict] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(True))
        if len(held) == size:
            yield pd.DataFrame(held)
            held = []
    if held:
        yield pd.DataFrame(held)


def eval_batches(df: DataFrame, size: int = 32, order_by: list[str] | None = None) -> DataFrame:
    """(batch, rows): all rows in batches of `size` in an order of their values, made on the executors."""
    placed = with_row_index(df, order_by or df.columns, "_row")
    return placed.groupBy(F.floor(F.col("_row") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_row", F.struct(*df.columns).alias("r")))).alias("b")).select("batch", F.transform("b", lambda x: x["r"]).alias("rows"))


def held_out(df: DataFrame, share: float = 0.1, key: str | None = None) -> DataFrame:
    """The test rows: a fixed share of the keys by md5, so the same key is always in or out."""
    value = F.col(key).cast("string") if key else row_key(df)
    return df.filter(md5_mod(value, 10_000) < int(share * 10_000))


def preprocess(df: DataFrame, tokens: str | None = None, actions: str | None = None, image: str | None = None, max_length: int = 512) -> DataFrame:
    """Model inputs: tokens cut or padded with a 0/1 mask, actions with 0 for what isn't finite, images (rows of pixels with channels) as channels of rows in [0, 1]."""
    out = df
    if tokens:
        out = out.withColumn(f"{tokens}_mask", A.length_mask(F.col(tokens), max_length)).withColumn(tokens, A.fit_length(F.col(tokens), max_length))
    if actions:
        finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
        out = out.withColumn(actions, F.transform(actions, finite))
    if image:
        channels = F.sequence(F.lit(0), F.size(F.col(image)[0][0]) - 1)
        out = out.withColumn(image, F.transform(channels, lambda c: F.transform(image, lambda row: F.transform(row, lambda px: F.get(px, c) / 255.0))))
    return out


def training_dataset(spark: SparkSession, path: str, shuffle: bool = True, seed: int = 42) -> DataFrame:
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df.orderBy(F.rand(seed)) if shuffle else df


def check_batch(df: DataFrame, required: list[str], actions: str | None = None, action_dim: int | None = None) -> DataFrame:
    """batch_errors: missing fields, actions that aren't finite or have another size."""
    errors = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) if c in df.columns else F.lit(f"missing:{c}") for c in required]
    if actions:
        odd = F.exists(actions, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        errors.append(F.when(odd, F.lit("not_finite")))
        if action_dim:
            errors.append(F.when(F.size(actions) != action_dim, F.lit("action_dim")))
    return df.withColumn("batch_errors", F.array_compact(F.array(*errors)))


def synthetic_texts(spark: SparkSession, n: int, seed: int = 0, text_type: str = "description", min_length: int = 10, max_length: int = 500) -> DataFrame:
    """(text_id, text, text_type, length, data_type, format, source): filled patterns of one type, fixed by seed and id.

    A shorter text is filled up by repeating it, a longer one is cut.
    """
    if text_type not in PATTERNS:
        raise ValueError(f"text_type must be one of {sorted(PATTERNS)}")
    pick = lambda words, salt: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(len(words))).cast("int"))
    text = pick(PATTERNS[text_type], "pattern")
    for k, words in WORDS.items():
        text = F.replace(text, F.lit("{" + k + "}"), pick(words, k))
    whole = F.repeat(F.concat("text", F.lit(" ")), F.ceil(F.lit(min_length) / F.length("text")).cast("int"))
    out = spark.range(n).withColumn("text", text).withColumn("text", F.when(F.length("text") < min_length, F.substring(whole, 1, min_length)).otherwise(F.substring("text", 1, max_length)))
    return out.select(
        F.col("id").alias("text_id"), "text", F.lit(text_type).alias("text_type"), F.length("text").alias("length"),
        F.lit("text").alias("data_type"), F.lit("synthetic").alias("format"), F.lit("synthetic_generator").alias("source"),
    )


def synthetic_videos(spark: SparkSession, n: int, frames: int = 8, height: int = 32, width: int = 32, seed: int = 0) -> DataFrame:
    """(video_id, frames, num_frames, resolution, data_type, format): grey frames with a square that moves on a straight line, fixed by seed and id."""

    def run(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            rng = np.random.default_rng([seed, i])
            side, step, at = int(rng.integers(3, 8)), rng.integers(-2, 3, 2), rng.integers(0, [height, width])
            made = []
            for _ in range(frames):
                image = np.zeros((height, width), np.uint8)
                image[np.ix_((at[0] + np.arange(side)) % height, (at[1] + np.arange(side)) % width)] = 255
                made.append(image.tobytes())
                at = at + step
            out.append(made)
        return pd.Series(out)

    made = F.pandas_udf(run, "array<binary>")
    return spark.range(n).select(
        F.col("id").alias("video_id"), made("id").alias("frames"), F.lit(frames).alias("num_frames"), F.array(F.lit(height), F.lit(width)).alias("resolution"),
        F.lit("video").alias("data_type"), F.lit("synthetic").alias("format"),
    )


def synthetic_trajectories(spark: SparkSession, n: int, length: int = 100, joints: int = 7, seed: int = 0) -> DataFrame:
    """Sinusoid joint positions and velocities, a base path, observations and actions; each trajectory is fixed by seed and id."""

    def run(ids: pd.Series) -> pd.DataFrame:
        out = []
        for i in ids:
            rng = np.random.default_rng([seed, i])
            t = np.linspace(0, 2 * np.pi, length)[:, None]
            k = np.arange(joints)[None, :]
            freq, amp = 0.3 + 0.1 * k + rng.uniform(-0.05, 0.05, k.shape), 0.5 + 0.1 * k + rng.uniform(-0.1, 0.1, k.shape)
            phase = rng.uniform(0, 2 * np.pi, k.shape)
            pos, vel = amp * np.sin(freq * t + phase), amp * freq * np.cos(freq * t + phase)
            radius = rng.uniform(1, 3)
            base = np.c_[radius * np.cos(t), radius * np.sin(t), 0.5 + 0.1 * np.sin(2 * t)]
            obs = np.c_[pos, base] + rng.normal(0, 0.01, (length, joints + 3))
            out.append((f"synth_{i:06d}", pos.tolist(), vel.tolist(), base.tolist(), obs.tolist(), (vel + rng.normal(0, 0.01, vel.shape)).tolist()))
        return pd.DataFrame(out, columns=["episode_id", "joint_positions", "joint_velocities", "base_pose", "observations", "actions"])

    m = "array<array<double>>"
    made = F.pandas_udf(run, f"episode_id string, joint_positions {m}, joint_velocities {m}, base_pose {m}, observations {m}, actions {m}")
    return spark.range(n).select(F.col("id").alias("trajectory_id"), made("id").alias("t")).select("trajectory_id", "t.*", F.lit("sensor").alias("data_type"), F.lit("synthetic").alias("format"))


def randomized_environments(spark: SparkSession, n: int, ranges: dict[str, dict[str, tuple[float, float] | float]] = RANGES) -> DataFrame:
    """(env_id and a struct a group): parameters drawn with the environment's index as seed, uniform in a range or normal around 0 with a spread."""
    return spark.range(n).select(F.col("id").alias("env_id"), *[F.struct(*[_drawn(spec, F.lit(g), F.lit(name), "id").alias(name) for name, spec in group.items()]).alias(g) for g, group in ranges.items()])


def _drawn(spec: tuple[float, float] | float, *keys: Column | str) -> Column:
    if isinstance(spec, tuple):
        return spec[0] + (spec[1] - spec[0]) * uniform(0, *keys)
    # a normal number from two uniform ones
    return spec * F.sqrt(-2 * F.log(1 - uniform(1, *keys))) * F.cos(2 * np.pi * uniform(2, *keys))


def randomize_records(df: DataFrame, image: str | None = "image", actions: str | None = "actions", key: str | None = None, ranges: dict = RANGES) -> DataFrame:
    """Image noise (values clipped to [0, 1]) and an action_delay, with what was drawn in domain_randomization; fixed by the row."""
    ident = F.col(key) if key else row_key(df)
    drawn = F.struct(*[F.struct(*[_drawn(spec, F.lit(g), F.lit(name), ident).alias(name) for name, spec in group.items()]).alias(g) for g, group in ranges.items()])
    out = df.withColumn("domain_randomization", drawn)
    if image in df.columns:
        spread = F.abs(F.col("domain_randomization.sensor.camera_noise"))
        out = out.withColumn(image, F.transform(image, lambda x, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + spread * _drawn(1.0, F.lit("pixel"), i, ident)))))
    if actions in df.columns:
        out = out.withColumn("action_delay", F.col("domain_randomization.dynamics.actuator_delay"))
    return out


def randomize(df: DataFrame, column: str, noise: float = 0.01, delay: int = 0, seed: int = 0, key: str | None = None) -> DataFrame:
    """Add Gaussian noise to an array column and delay it by so many steps (the first value is repeated); fixed by seed and row."""

    def run(values: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for v, k in zip(values, keys):
            if v is None:
                out.append(None)
                continue
            x = np.asarray(v, float) + np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF]).normal(0, noise, len(v))
            out.append(np.r_[np.repeat(x[:1], min(delay, len(x))), x[: max(0, len(x) - delay)]])
        return pd.Series(out)

    k = F.xxhash64(F.col(key) if key else row_key(df))
    return df.withColumn(column, F.pandas_udf(run, "array<double>")(column, k))
