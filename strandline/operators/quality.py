"""Dataset quality: jumps, frozen and non-finite values, duplicates, trimming, repair, scores.

Thresholds are this library's own and are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import q


def value_jumps(frames: DataFrame, *, by: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Frames whose value moved by more than ``threshold`` since the frame before."""
    step = F.abs(q(value) - F.lag(q(value)).over(Window.partitionBy(*by).orderBy(*order)))
    return frames.withColumn("step", step).where(F.col("step") > threshold)


def temporal_gaps(frames: DataFrame, *, by: list[str], order: list[str], seconds: Column, fps: float, tolerance: float = 0.5) -> DataFrame:
    """Frames that are not 1 / fps after the frame before, within a share of a frame, or not after it at all."""
    gap = seconds - F.lag(seconds).over(Window.partitionBy(*by).orderBy(*order))
    return frames.withColumn("gap", gap).where((F.abs(F.col("gap") - 1.0 / fps) > tolerance / fps) | (F.col("gap") <= 0))


def value_faults(frames: DataFrame, *, by: list[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """For each group: non-finite, missing and clipped values, and whether the value never changes."""
    v = q(value)
    infinite = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    clipped = F.lit(False)
    if low is not None:
        clipped = clipped | (v <= low)
    if high is not None:
        clipped = clipped | (v >= high)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return frames.groupBy(*by).agg(count(v.isNull()).alias("missing"), count(infinite).alias("non_finite"), count(clipped).alias("clipped"), F.coalesce(F.stddev_pop(v) == 0, F.lit(True)).alias("frozen"))


def duplicate_payloads(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """Digests that more than one row has, with how many and the least key; texts are hashed before the shuffle."""
    return rows.select(F.sha2(q(payload), 256).alias("digest"), q(key).alias("key")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key")).where("copies > 1")


def trim_static(frames: DataFrame, *, by: list[str], order: list[str], value: str, threshold: float = 0.01, min_active: int = 1) -> DataFrame:
    """Drops still frames before the first and after the last movement, and numbers the rest from 0.

    Groups with fewer than ``min_active`` moving frames are dropped whole.
    """
    ordered = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    moving = frames.withColumn("__mv", F.abs(q(value) - F.lag(q(value)).over(ordered)) > threshold).withColumn("__rn", F.row_number().over(ordered))
    at = F.when(F.col("__mv"), F.col("__rn"))
    bounds = moving.withColumn("__a", F.min(at).over(whole)).withColumn("__z", F.max(at).over(whole)).withColumn("__n", F.count(at).over(whole))
    kept = bounds.where((F.col("__rn") >= F.col("__a")) & (F.col("__rn") <= F.col("__z")) & (F.col("__n") >= min_active))
    return kept.withColumn("frame_index", (F.col("__rn") - F.col("__a")).cast("bigint")).drop("__mv", "__rn", "__a", "__z", "__n")


def fix_timestamps(frames: DataFrame, *, by: list[str], order: list[str], fps: float) -> DataFrame:
    """Frames numbered from 0 in order, with the timestamps that the rate gives."""
    numbered = frames.withColumn("frame_index", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    return numbered.withColumn("timestamp", (F.col("frame_index") / F.lit(float(fps))).cast("float"))


def fix_nan(frames: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """Non-finite and missing values take the last good value before them, or else the first after."""
    good = F.when(F.isnan(q(value)) | (F.abs(q(value)) == F.lit(float("inf"))), None).otherwise(q(value))
    ordered = Window.partitionBy(*by).orderBy(*order)
    before = F.last(good, True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # where nothing good came before, the first good value after is the first of all
    first = F.first(good, True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn(value, F.coalesce(before, first))


def episode_lengths(frames: DataFrame, by: list[str], *, short: int = 10) -> DataFrame:
    """Length of each episode and whether it is short."""
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("length")).withColumn("short", F.col("length") < short)


def consistency(frames: DataFrame, vectors: list[str]) -> DataFrame:
    """For each vector feature, how many sizes it has; one size is consistent."""
    return frames.agg(*(F.count_distinct(F.size(q(v))).alias(v) for v in vectors))


def statistics_drift(stored: DataFrame, computed: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose stored mean or std is not what the frames give."""
    from .compare import compare_frames

    return compare_frames(stored.select(*by, "mean", "std"), computed.select(*by, "mean", "std"), by).where("status <> 'same'")


def episode_score(frames: DataFrame, *, by: list[str], order: list[str], value: str, jump: float, short: int = 10, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """A score from 0 to 1 for each episode: few jumps, movement, length enough; and the reasons against it."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    stepped = frames.withColumn("__jump", F.coalesce((F.abs(q(value) - F.lag(q(value)).over(ordered)) > jump).cast("int"), F.lit(0)))
    told = stepped.groupBy(*by).agg(F.count(F.lit(1)).alias("length"), F.sum("__jump").alias("jumps"), (F.coalesce(F.stddev_pop(q(value)), F.lit(0.0)) > 0).cast("int").alias("moves"))
    a, b, c = weights
    score = F.lit(a) * (1 - F.col("jumps") / F.col("length")) + F.lit(b) * F.col("moves") + F.lit(c) * F.least(F.lit(1.0), F.col("length") / F.lit(float(short)))
    reasons = F.concat_ws(",", F.when(F.col("jumps") > 0, "jumps"), F.when(F.col("moves") == 0, "frozen"), F.when(F.col("length") < short, "short"))
    return told.select(*by, "length", "jumps", score.alias("score"), reasons.alias("reasons"))


def kinematic_violations(frames: DataFrame, limits: DataFrame, *, by: list[str], order: list[str], vector: str, seconds: str) -> DataFrame:
    """Joint positions and speeds outside ``limits`` (component, low, high, max_speed)."""
    parts = frames.select(*by, *order, F.col(seconds).alias("__t"), F.posexplode(q(vector)).alias("component", "position")).join(F.broadcast(limits), "component")
    ordered = Window.partitionBy(*by, "component").orderBy(*order)
    speed = (F.col("position") - F.lag("position").over(ordered)) / (F.col("__t") - F.lag("__t").over(ordered))
    judged = parts.withColumn("speed", speed)
    return judged.where((F.col("position") < F.col("low")) | (F.col("position") > F.col("high")) | (F.abs("speed") > F.col("max_speed"))).select(*by, *order, "component", "position", "speed")


def outliers(rows: DataFrame, *, by: list[str], value: str, sigmas: float = 6.0) -> DataFrame:
    """For each group: values, how many lie more than ``sigmas`` standard deviations from the mean, and whether all are equal."""
    told = rows.groupBy(*by).agg(F.avg(q(value)).alias("__m"), F.stddev_pop(q(value)).alias("__s"))
    far = (F.abs(q(value) - F.col("__m")) > F.lit(sigmas) * F.col("__s")) & (F.col("__s") > 0)
    counted = rows.join(told, by).groupBy(*by).agg(F.count(q(value)).alias("n"), F.sum(F.coalesce(far, F.lit(False)).cast("bigint")).alias("outliers"), (F.coalesce(F.max("__s"), F.lit(0.0)) == 0).alias("constant"))
    return counted


def imbalance(lengths: DataFrame, *, by: str, length: str = "length", ratio: float = 10.0) -> DataFrame:
    """For each task: episodes, frames, its share of all frames, and whether the largest task has ``ratio`` times as many."""
    tasks = lengths.groupBy(by).agg(F.count(F.lit(1)).alias("episodes"), F.sum(length).alias("frames"))
    whole = tasks.agg(F.sum("frames").alias("__all"), F.max("frames").alias("__most"))
    joined = tasks.join(F.broadcast(whole), F.lit(True))  # one row
    return joined.select(by, "episodes", "frames", (F.col("frames") / F.col("__all")).alias("share"), (F.col("__most") > F.lit(ratio) * F.col("frames")).alias("rare"))


def too_short(lengths: DataFrame, *, length: str = "length", window: int) -> DataFrame:
    """Episodes that do not fill a policy's window of frames."""
    return lengths.where(F.col(length) < window)
