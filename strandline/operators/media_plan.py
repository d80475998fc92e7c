"""Plans for media: which files an edit touches and how, faults of slices, and what is read how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slice_faults(slices: DataFrame, *, file: str, start: str, stop: str, fps: float, duration: str, tolerance: float = 0.01) -> DataFrame:
    """Slices with a ``fault``: off_frame, outside the file, or overlapping the slice before."""
    before = F.lag(stop).over(Window.partitionBy(file).orderBy(start, stop))
    frames = F.col(start) * F.lit(float(fps))
    fault = F.when(F.abs(frames - F.round(frames)) > tolerance, "off_frame").when((F.col(start) < 0) | (F.col(stop) > F.col(duration) + F.lit(1e-7)), "outside").when(F.col(start) < before - F.lit(1e-7), "overlap")
    return slices.withColumn("fault", fault).where("fault is not null")


def media_modes(slices: DataFrame, kept: DataFrame, *, file: str, key: str, frames: str, changes_pixels: Column, keyframe_safe: Column) -> DataFrame:
    """For each file, the cheapest way to keep the slices of ``kept``: reuse, remux, transcode or drop."""
    marked = slices.join(kept.select(key).distinct().withColumn("__kept", F.lit(1)), key, "left")
    whole = marked.groupBy(file).agg(F.sum(frames).alias("frames"), F.sum(F.when(F.col("__kept") == 1, F.col(frames)).otherwise(0)).alias("kept_frames"), F.min(keyframe_safe.cast("int")).alias("__safe"), F.max(changes_pixels.cast("int")).alias("__pixels"))
    mode = F.when(F.col("kept_frames") == 0, "drop").when(F.col("__pixels") == 1, "transcode").when(F.col("kept_frames") == F.col("frames"), "reuse").when(F.col("__safe") == 1, "remux").otherwise("transcode")
    return whole.select(file, "frames", "kept_frames", mode.alias("mode"))


def resource_profile(uses: DataFrame, *, resource: str, size: str) -> DataFrame:
    """Each distinct resource with its bytes and how many episodes use it."""
    return uses.groupBy(resource).agg(F.max(size).alias("bytes"), F.count(F.lit(1)).alias("uses"))


def longest_needed(slices: DataFrame, *, file: str, stop: str) -> DataFrame:
    """How much of each file its slices need."""
    return slices.groupBy(file).agg(F.max(stop).alias("needed"))


def pixel_stats(moments: DataFrame, by: list[str], *, count: str = "n", total: str = "s", squares: str = "ss", low: str = "lo", high: str = "hi") -> DataFrame:
    """min, max, mean and std in [0, 1] from sums over 8-bit pixels; the variance is not below 0."""
    n = F.col(count)
    mean = F.col(total) / n / 255.0
    std = F.sqrt(F.greatest(F.lit(0.0), F.col(squares) / n / (255.0 * 255.0) - mean * mean))
    return moments.select(*by, (F.col(low) / 255.0).alias("min"), (F.col(high) / 255.0).alias("max"), mean.alias("mean"), std.alias("std"), n.alias("count"))
