"""Streams on different clocks: as-of joins, tail alignment and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_clamped(anchors: DataFrame, samples: DataFrame, *, by: list[str], on: str, value: str, tie: list[str], tolerance_first: bool = True) -> DataFrame:
    """Adds to each anchor the last sample at or before it, or else the first sample.

    Both streams go into one sort by (key, time) with samples before anchors on
    ties: one shuffle, no comparison of pairs.  ``tie`` orders rows of equal
    time.  Without ``tolerance_first`` an early anchor gets null.
    """
    extra = [c for c in anchors.columns if c not in (*by, on)]
    left = anchors.select(*by, on, F.lit(1).alias("__side"), *extra, F.lit(None).cast(samples.schema[value].dataType).alias("__v"))
    fill = [F.col(c) if c in samples.columns and c in tie else F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    right = samples.select(*by, on, F.lit(0).alias("__side"), *fill, F.col(value).alias("__v"))
    both = left.unionByName(right)
    order = Window.partitionBy(*by).orderBy(on, "__side", *tie)
    last = F.last("__v", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # an anchor with no sample before it takes the key's first one: that of the whole partition, found once
    first = F.first("__v", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if tolerance_first else F.lit(None)
    return both.select(*by, on, "__side", *extra, F.coalesce(last, first).alias(value)).where("__side = 1").drop("__side")


def tail_align(streams: DataFrame, *, by: list[str], stream: str, names: list[str], order: list[str], value: str) -> DataFrame:
    """Keeps the newest rows that every stream has and pairs them by position.

    One row for each (key, frame_index) with a column for each stream: streams
    are numbered from their newest row, and a pivot by that number replaces the
    joins.
    """
    used = streams.where(F.col(stream).isin(names))
    newest = Window.partitionBy(*by, stream).orderBy(*(F.desc(c) for c in order))
    ranked = used.withColumn("__rank", F.row_number().over(newest))
    paired = ranked.groupBy(*by, "__rank").agg(F.count(F.lit(1)).alias("__n"), *(F.max(F.when(F.col(stream) == n, F.col(value))).alias(n) for n in names)).where(F.col("__n") == len(names))
    length = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return paired.withColumn("frame_index", (length - F.col("__rank")).cast("bigint")).select(*by, "frame_index", *names)


def range_join(rows: DataFrame, ranges: DataFrame, *, key: str, start: str = "start", stop: str = "stop", bucket: int = 1024) -> DataFrame:
    """Rows with the half-open ranges that hold their key.

    Ranges are cut into buckets of the key, so the join is an equi-join on the
    bucket followed by the exact test; no side is broadcast or crossed.
    """
    cut = ranges.where(F.col(stop) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(stop) - 1) / bucket))))
    keyed = rows.withColumn("__b", F.floor(F.col(key) / bucket))
    return keyed.join(cut, "__b").where((F.col(key) >= F.col(start)) & (F.col(key) < F.col(stop))).drop("__b")
