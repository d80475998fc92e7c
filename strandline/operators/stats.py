"""Statistics of features: per episode, merged, quantile envelopes and nearest ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import q


def scalar_stats(frames: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, max, mean, population std and count of a number; partial aggregates only."""
    return frames.groupBy(*by).agg(F.min(q(value)).alias("min"), F.max(q(value)).alias("max"), F.avg(q(value)).alias("mean"), F.stddev_pop(q(value)).alias("std"), F.count(q(value)).alias("count"))


def vector_stats(frames: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same for each component of an array column, one row for a component."""
    parts = frames.select(*by, F.posexplode(q(value)).alias("component", "x"))
    return parts.groupBy(*by, "component").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def merge_moments(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of the union from statistics of its parts.

    var = sum((v + (m - mean)^2) n) / N in two steps, so no large squares cancel;
    parts of no rows count for nothing.
    """
    keys = by or []
    used = stats.where(F.col("count") > 0)
    mean = used.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("__mean"))
    joined = used.join(mean, keys) if keys else used.crossJoin(F.broadcast(mean))
    spread = F.col("std") * F.col("std") + (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))
    return joined.groupBy(*keys).agg(F.max("__mean").alias("mean"), F.sqrt(F.sum(spread * F.col("count")) / F.sum("count")).alias("std"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


#: Blocks of values in which running counts are taken.
BLOCKS = 256


def counts_upto(counted: DataFrame, value: str, count: str, by: list[str] | None = None, name: str = "__upto") -> DataFrame:
    """Adds the running sum of ``count`` over distinct values in order, for each group.

    Values are cut into BLOCKS blocks at approximate quantiles of the distinct
    values; blocks are summed, then values within a block.  So neither a group
    nor all values meet in one window, and only a row for each block does.
    """
    keys = by or []
    edges = counted.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(k / BLOCKS) for k in range(1, BLOCKS))), F.lit(10_000)).alias("e")).first()["e"]
    edges = sorted({float(x) for x in edges or [] if x is not None})
    block = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value).cast("double"))) if edges else F.lit(0)
    blocked = counted.withColumn("__block", block)
    sums = blocked.groupBy(*keys, "__block").agg(F.sum(count).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select(*keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocked.withColumn(name, F.sum(count).over(within)).join(placed, [*keys, "__block"]).withColumn(name, F.col(name) + F.col("__before")).drop("__block", "__before")


def quantile_stats(frames: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation, for the named points.

    Ranks come from counts of distinct values in blocks (counts_upto), so a
    group's values never gather in one task.
    """
    counted = frames.where(q(value).isNotNull()).groupBy(*by, q(value).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = counts_upto(counted, "__x", "__n", by)
    total = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    both = ranked.join(total, by)
    out = []
    for name, p in points.items():
        at = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        pick = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__x").cast("double")))
        out += [pick(low).alias(f"{name}__l"), pick(high).alias(f"{name}__h"), F.max(at - low).alias(f"{name}__f")]
    picked = both.groupBy(*by).agg(*out)
    value_at = lambda n: F.col(f"{n}__l") + (F.col(f"{n}__h") - F.col(f"{n}__l")) * F.col(f"{n}__f")
    # groups without any value keep their row
    return frames.select(*by).distinct().join(picked.select(*by, *(value_at(n).alias(n) for n in points)), by, "left")


def quantile_envelope(stats: DataFrame, key: str, quantile: str, value: str, owner: str) -> DataFrame:
    """For each quantile that every owner has: the least value up to the median, the greatest above.

    ``quantile`` holds names like q05; the result is an envelope of the parts'
    quantiles, not a quantile of the union.
    """
    owners = stats.groupBy(key).agg(F.count_distinct(F.col(owner)).alias("__owners"))
    level = F.regexp_extract(quantile, r"^q(\d+)$", 1).try_cast("int")
    merged = stats.groupBy(key, quantile).agg(F.count_distinct(F.col(owner)).alias("__n"), F.when(F.max(level) <= 50, F.min(value)).otherwise(F.max(value)).alias(value))
    return merged.join(owners, key).where(F.col("__n") == F.col("__owners")).select(key, quantile, value)


def nearest_rank(values: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """count, total, min, max and nearest ranks with ties rounded to even; zeros for no rows.

    Ranks come from counts of distinct values, taken in blocks.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    upto = counts_upto(counted, value, "__n")
    whole = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("count"), F.coalesce(F.sum(F.col(value) * F.col("__n")), F.lit(0)).alias("total"))

    def rank(p: float) -> Column:
        return F.least(F.col("count") - 1, F.bround((F.col("count") - 1) * F.lit(p), 0).cast("bigint"))

    joined = upto.crossJoin(F.broadcast(whole))
    picked = joined.agg(F.max("count").alias("count"), F.max("total").alias("total"), F.min(value).alias("min"), *(F.min(F.when(F.col("__upto") > rank(p), F.col(value))).alias(name) for name, p in points.items()), F.max(value).alias("max"))
    return picked.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in picked.columns))
