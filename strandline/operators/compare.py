"""Comparison and validation of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import arrays_close, nested_close, q


def _differs(kind: T.DataType, left: Column, right: Column, tolerant: bool, nan_equal: bool) -> Column:
    number = isinstance(kind, T.FloatType | T.DoubleType)
    if number and tolerant:
        same = nested_close(left, right, nan_equal=nan_equal)
    elif number and not nan_equal:
        same = (left == right) & ~F.isnan(left)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) and tolerant:
        same = arrays_close(left, right)
    else:
        same = left.eqNullSafe(right)
    return ~F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(same)


def compare_frames(left: DataFrame, right: DataFrame, key: list[str], *, columns: list[str] | None = None, tolerant: bool = True, nan_equal: bool = False) -> DataFrame:
    """Each key with ``status``: left_only, right_only, differs or same.

    One full outer join on the key; all columns are compared in the same pass.
    Numbers agree within rtol 1e-6 of the right and atol 1e-7 if ``tolerant``;
    NaN differs from NaN unless ``nan_equal``.
    """
    names = [c for c in (columns or left.columns) if c not in key]
    a = left.select(*(q(k).alias(k) for k in key), F.struct(*(q(c).alias(f"c{i}") for i, c in enumerate(names)), F.lit(1).alias("there")).alias("__l"))
    b = right.select(*(q(k).alias(k) for k in key), F.struct(*(q(c).alias(f"c{i}") for i, c in enumerate(names)), F.lit(1).alias("there")).alias("__r"))
    differs = F.lit(False)
    for i, c in enumerate(names):
        differs = differs | _differs(left.schema[c].dataType, F.col(f"__l.c{i}"), F.col(f"__r.c{i}"), tolerant, nan_equal)
    status = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").when(differs, "differs").otherwise("same")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def first_differences(compared: DataFrame, key: list[str], limit: int = 50) -> DataFrame:
    """The first keys that are not the same, in order: the report of a comparison."""
    return compared.where("status <> 'same'").orderBy(*key).limit(limit)


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the number of times that left has them more often than right (negative: less often).

    One aggregate over the union; partial sums go before the shuffle, so a row
    that repeats a million times is one row there.
    """
    counted = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    return counted.groupBy(*left.columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def validation_errors(frames: DataFrame, episodes: DataFrame, *, total_episodes: int | None = None, total_frames: int | None = None) -> DataFrame:
    """(code, episode_index, message) of every structural error.

    Episode numbers run from 0 without gaps; totals agree with the metadata;
    each episode has as many frames as it says, and they are numbered from 0.
    """
    spark = frames.sparkSession
    whole = episodes.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("f"), F.min("episode_index").alias("a"), F.max("episode_index").alias("b"), F.count_distinct(F.col("episode_index")).alias("d")).first()
    found = []
    if total_episodes is not None and whole["n"] != total_episodes:
        found.append(("total_episodes", None, f"metadata says {total_episodes}, there are {whole['n']}"))
    if whole["n"] and (whole["a"] != 0 or whole["b"] != whole["n"] - 1 or whole["d"] != whole["n"]):
        found.append(("episode_indices", None, "episodes are not numbered from 0 without gaps"))
    if total_frames is not None and (whole["f"] or 0) != total_frames:
        found.append(("total_frames", None, f"metadata says {total_frames}, lengths sum to {whole['f'] or 0}"))
    top = spark.createDataFrame(found, "code string, episode_index bigint, message string")
    counted = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("rows"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.count_distinct(F.col("frame_index")).alias("d"))
    both = episodes.select("episode_index", "length").join(counted, "episode_index", "full_outer")
    rows = both.where(F.coalesce("length", F.lit(-1)) != F.coalesce("rows", F.lit(0))).select(F.lit("row_count").alias("code"), "episode_index", F.format_string("metadata says %s, there are %s", F.coalesce(F.col("length").cast("string"), F.lit("nothing")), F.coalesce("rows", F.lit(0)).cast("string")).alias("message"))
    order = both.where((F.col("lo") != 0) | (F.col("hi") != F.col("rows") - 1) | (F.col("d") != F.col("rows"))).select(F.lit("frame_index").alias("code"), "episode_index", F.lit("frames are not numbered from 0 without gaps").alias("message"))
    return top.unionByName(rows).unionByName(order)


def payload_digest(frames: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """SHA-256 of the payloads of each group in order, one group being one episode of one camera."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(q(order).alias("o"), q(payload).alias("p")))), lambda x: x["p"])
    return frames.groupBy(*by).agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def file_rows(parts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows that a file's metadata promises and rows that it has, for every file of either side."""
    have = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return parts.join(have, key, "full_outer")
