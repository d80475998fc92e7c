"""Sizes of outputs and what a dataset and a session are made of; driver-side rules over metadata."""

from __future__ import annotations

import heapq
import platform
from typing import Any

import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dataset
from ..operators.pack import greedy_groups
from ..operators.stats import nearest_rank
from ..sinks.layouts import episode_sizes
from ..sources import files


def makespan(sizes: list[int], workers: int) -> int:
    """The busiest worker's load when each group goes to the least loaded one in order."""
    loads = [0] * max(1, workers)
    for s in sizes:
        heapq.heappush(loads, heapq.heappop(loads) + s)
    return max(loads)


def target_for_balance(sizes: list[int], candidates: list[int], workers: int, preferred: int) -> int:
    """Of the candidate file sizes, the one with the least makespan, then the fewest files, then nearest to ``preferred``."""

    def cost(limit: int) -> tuple[int, int, int]:
        groups: dict[int, int] = {}
        for g, s in zip(greedy_groups(sizes, limit), sizes, strict=True):
            groups[g] = groups.get(g, 0) + s
        return makespan(list(groups.values()), workers), len(groups), abs(limit - preferred)

    return min(candidates, key=cost)


def target_for_parallelism(total: int, workers: int, preferred: int, least: int) -> int:
    """The preferred file size, or a smaller one (down to ``least``) if there would be fewer files than workers."""
    return max(least, min(preferred, -(-total // max(1, workers))))


def size_profile(data: Dataset) -> dict[str, Any]:
    """Distribution of the episodes' stored bytes."""
    sizes: DataFrame = episode_sizes(data).select(F.col("bytes").cast("bigint").alias("bytes"))
    return nearest_rank(sizes, "bytes", {"p50": 0.5, "p95": 0.95}).first().asDict()


def resources(spark: SparkSession, root: str) -> dict[str, Any]:
    """Files and bytes below a folder, and the session's parallelism."""
    listed = files.listing(spark, root)
    return {"files": len(listed), "bytes": sum(n for _, n in listed), "parallelism": spark.sparkContext.defaultParallelism}


def environment_report(spark: SparkSession | None = None) -> dict[str, Any]:
    """Versions, and which optional packages are there."""
    from importlib.util import find_spec

    out: dict[str, Any] = {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__}
    out["optional"] = {name: find_spec(name) is not None for name in ("h5py", "av")}
    if spark is not None:
        out["master"] = spark.sparkContext.master
    return out
