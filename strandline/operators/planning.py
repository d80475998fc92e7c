"""Rules that plan work: order of jobs, samples under a budget, how many workers pay, where a path lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def largest_first(jobs: DataFrame, *, cost: str, key: str, by: list[str] | None = None, name: str = "turn") -> DataFrame:
    """Numbers jobs from 0, the costliest first, equal ones by key; within each group of ``by``."""
    order = Window.partitionBy(*(by or [])).orderBy(F.desc(cost), key)
    return jobs.withColumn(name, (F.row_number().over(order) - 1).cast("bigint"))


def head_within(resources: DataFrame, *, size: str, key: str, budget: int, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The smallest resources that fit a budget of bytes together, at least one that fits alone, ``most`` at most.

    Resources larger than the budget are passed over.
    """
    order = Window.partitionBy(*(by or [])).orderBy(size, key)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = resources.where(F.col(size) <= budget).withColumn("__upto", F.sum(size).over(upto)).withColumn("__n", F.row_number().over(order))
    kept = fits.where((F.col("__upto") <= budget) | (F.col("__n") == 1))
    return (kept.where(F.col("__n") <= most) if most is not None else kept).drop("__upto", "__n")


def least_near_peak(measured: DataFrame, *, workers: str, throughput: str, by: list[str], share: float = 0.97) -> DataFrame:
    """For each group the fewest workers whose throughput comes within a share of the peak."""
    peak = F.max(throughput).over(Window.partitionBy(*by))
    return measured.withColumn("__peak", peak).where(F.col(throughput) >= F.col("__peak") * F.lit(share)).groupBy(*by).agg(F.min(workers).alias(workers))


def throughput_knee(measured: DataFrame, *, workers: str, throughput: str, by: list[str], gain: float = 1.03) -> DataFrame:
    """For each group the last number of workers that beat the best before it by more than a gain.

    Steps are taken in order; a step that does not gain leaves the best as it
    is, so the fold runs over the few steps of a group as an array.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(workers).cast("bigint").alias("w"), F.col(throughput).cast("double").alias("t"))))
    start = F.struct(F.lit(None).cast("bigint").alias("w"), F.lit(0.0).alias("t"))
    best = F.aggregate(steps, start, lambda acc, s: F.when(s["t"] > acc["t"] * F.lit(gain), s).otherwise(acc))
    return measured.groupBy(*by).agg(best["w"].alias(workers))


def sample_batches(jobs: DataFrame, *, order: str, size: str, steps: list[int], budget: int, name: str = "step") -> DataFrame:
    """The jobs that trial runs with ``steps`` workers take: disjoint stretches in order, or else prefixes.

    A step takes as many jobs as it has workers.  Steps run while jobs and the
    budget of bytes last; if disjoint stretches do not reach the last step but
    prefixes do, all steps take prefixes.
    """
    need = sum(steps)
    head = jobs.orderBy(order).limit(need)  # as many jobs as all steps take, however many there are
    ranked = head.withColumn("__n", F.row_number().over(Window.orderBy(order)) - 1)
    edges, at = [], 0
    for i, k in enumerate(steps):
        edges.append((i, at, at + k, k))
        at += k
    plan = head.sparkSession.createDataFrame(edges, "step int, lo int, hi int, k int")
    total = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def stretch(lo, hi):
        met = plan.join(ranked, (F.col("__n") >= lo) & (F.col("__n") < hi))
        sums = met.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
        good = plan.join(sums, "step", "left").withColumn("__b", F.sum("b").over(total)).withColumn("ok", (F.coalesce("n", F.lit(0)) == F.col("k")) & (F.col("__b") <= budget))
        good = good.withColumn("ok", F.min(F.col("ok").cast("int")).over(total) == 1)
        return met, good

    apart, fine = stretch(F.col("lo"), F.col("hi"))
    prefix, enough = stretch(F.lit(0), F.col("k"))
    whole = fine.agg(F.min(F.col("ok").cast("int")).alias("apart")).join(enough.agg(F.min(F.col("ok").cast("int")).alias("prefix")), F.lit(True))
    mode = whole.select(((F.col("apart") == 0) & (F.col("prefix") == 1)).alias("prefixes"))
    columns = [F.col("step").alias(name), *(F.col(c) for c in jobs.columns)]
    one = apart.join(fine.where("ok").select("step"), "step").join(F.broadcast(mode), ~F.col("prefixes")).select(*columns)
    two = prefix.join(F.broadcast(mode), F.col("prefixes")).select(*columns)
    return one.unionByName(two)


def longest_prefix(paths: DataFrame, mounts: DataFrame, *, path: str, mount: str) -> DataFrame:
    """Paths with the innermost mount that holds them: an equi-join on the paths' own prefixes."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, "/").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    spread = paths.withColumn("__parts", parts).withColumn("__p", F.explode(F.array_distinct(prefixes))).drop("__parts")
    named = mounts.withColumn("__p", F.when(F.col(mount) == "/", "/").otherwise(F.regexp_replace(mount, "/+$", "")))
    met = spread.join(named, "__p")
    return met.groupBy(path).agg(F.max_by(F.struct(*(F.col(c) for c in mounts.columns)), F.length("__p")).alias("__m")).select(path, "__m.*")
