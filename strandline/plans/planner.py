"""What a conversion will cost and how to run it: a profile of the dataset, target sizes, and the session's settings."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dataset, normalize_version
from ..operators.stats import nearest_rank
from ..sources.footers import data_profile
from ..sources.layouts import open_dataset
from .datasets import convert

MIB = 1 << 20
#: File sizes in MiB that a plan chooses from.
DATA_TARGETS, VIDEO_TARGETS = (16, 32, 64, 100, 128, 256, 512), (64, 100, 200, 256, 400, 800)


def data_resources(spark: SparkSession, data: Dataset) -> DataFrame:
    """(path, rows, stored, logical, episodes): each data file once, with how many episodes lie in it."""
    return data_profile(spark, data).groupBy("path", "rows", "stored", "logical").agg(F.count(F.lit(1)).alias("episodes"))


def media_resources(data: Dataset) -> DataFrame:
    """(path, bytes, episodes): each video file once, whole; a slice's file counts in full."""
    from ..media.jobs import slice_paths
    from ..sources import stores

    def run(batches):
        for batch in batches:
            yield batch.assign(bytes=[stores.size(p) or 0 for p in batch["path"]])

    spark = data.frames.sparkSession
    files = slice_paths(data).groupBy("path").agg(F.count(F.lit(1)).alias("episodes"))
    return files.repartition(2 * spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path string, episodes bigint, bytes bigint")


def distribution(values: DataFrame, column: str) -> dict[str, Any]:
    """count, total, min, p50, p95 and max by nearest ranks."""
    return nearest_rank(values.select(F.col(column).cast("bigint").alias("v")), "v", {"p50": 0.5, "p95": 0.95}).first().asDict()


def bytes_per_row(logical: int, frames: int) -> int:
    return max(1, logical // max(1, frames))


@dataclass(frozen=True)
class Profile:
    version: str
    episodes: int
    frames: int
    cameras: int
    data_files: int
    video_files: int
    logical: dict[str, Any]
    stored: dict[str, Any]
    media: dict[str, Any]
    episodes_per_file: dict[str, Any]
    bytes_per_row: int


def profile(spark: SparkSession, source: str | Dataset) -> Profile:
    """Distinct files of a dataset and how their sizes and uses are distributed."""
    data = open_dataset(spark, source) if isinstance(source, str) else source
    files = data_resources(spark, data).persist()
    media = media_resources(data).persist()
    whole = data.episodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("f")).first()
    logical, stored, videos = distribution(files, "logical"), distribution(files, "stored"), distribution(media, "bytes")
    return Profile(data.info.version, whole["n"], whole["f"], len(data.info.cameras), logical["count"], videos["count"], logical, stored, videos, distribution(files, "episodes"), bytes_per_row(logical["total"], whole["f"]))


@dataclass(frozen=True)
class ConversionPlan:
    """Settings of one conversion, and why."""

    target_version: str
    data_mb: float
    video_mb: float
    data_tasks: int
    video_tasks: int
    shuffle_partitions: int
    reasons: tuple[str, ...]

    def to_json(self) -> dict[str, Any]:
        return asdict(self)


def _balanced(targets: tuple[int, ...], total: int, workers: int, preferred: int) -> int:
    """The size whose files fill whole rounds of the workers best, then the one nearest to the preferred."""

    def cost(mb: int) -> tuple[float, int]:
        files = max(1, math.ceil(total / (mb * MIB)))
        return math.ceil(files / workers) * mb, abs(mb - preferred)

    return min(targets, key=cost) if total > preferred * MIB else preferred


def plan_conversion(spark: SparkSession, source: str | Dataset, target_version: str, *, data_mb: float | None = None, video_mb: float | None = None) -> tuple[ConversionPlan, Profile]:
    """File sizes and partitions for a conversion, from the dataset and the session; given sizes are kept."""
    found = profile(spark, source)
    version = normalize_version(target_version)
    if version == "v2.1" and (data_mb or video_mb):
        raise ValueError("sizes of packed files do not apply to v2.1")
    if any(x is not None and x <= 0 for x in (data_mb, video_mb)):
        raise ValueError("sizes must be positive")
    cores = spark.sparkContext.defaultParallelism
    reasons = []
    data_target = data_mb or _balanced(DATA_TARGETS, found.logical["total"], cores, 100)
    video_target = video_mb or _balanced(VIDEO_TARGETS, found.media["total"], cores, 200)
    if version == "v3.0":
        data_tasks = max(1, math.ceil(found.logical["total"] / (data_target * MIB)))
        video_tasks = max(found.cameras, math.ceil(found.media["total"] / (video_target * MIB))) if found.video_files else 0
        reasons.append(f"{data_tasks} data files of {data_target} MiB for {cores} cores")
    else:
        data_tasks, video_tasks = max(1, found.episodes), found.episodes * found.cameras
        reasons.append(f"a file for each of {found.episodes} episodes")
    # a partition of frames should fit a task's share of memory with room for its copy in Arrow
    partitions = max(cores, math.ceil(found.logical["total"] / (128 * MIB)))
    reasons.append(f"{partitions} partitions of at most 128 MiB")
    return ConversionPlan(version, data_target, video_target, data_tasks, video_tasks, partitions, tuple(reasons)), found


def plan_and_convert(spark: SparkSession, source: str, destination: str, target_version: str, *, overwrite: bool = False, deep: bool = False, data_mb: float | None = None, video_mb: float | None = None) -> dict[str, Any]:
    """Plans a conversion and runs it with the planned sizes and partitions; the session's settings are put back."""
    plan, _ = plan_conversion(spark, source, target_version, data_mb=data_mb, video_mb=video_mb)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(plan.shuffle_partitions))
    try:
        done = convert(spark, source, destination, target_version, data_mb=plan.data_mb, video_mb=plan.video_mb, overwrite=overwrite, deep=deep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return done | {"plan": plan.to_json()}
