"""Merging episodic datasets: an ordered union with remapped episodes, frames and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import merged_task_dictionary, running_offsets

#: Bits left for an episode within a source in the order key of a merge.
_SHIFT = 1 << 40


def merged_episodes(episodes: DataFrame) -> DataFrame:
    """(source_ordinal, local_episode, length) with episode_index and dataset_from_index in the union."""
    keyed = episodes.withColumn("__key", F.col("source_ordinal") * F.lit(_SHIFT) + F.col("local_episode"))
    placed = running_offsets(keyed.withColumn("__one", F.lit(1)), "__key", "length")
    return running_offsets(placed, "__key", "__one", start="episode_index", stop="__stop").drop("__key", "__one", "__stop")


def merge_frames(frames: DataFrame, episodes: DataFrame, tasks: DataFrame | None = None, *, check_size: int = 2_000_000) -> DataFrame:
    """Frames of all sources with episode_index, index and task_index of the union.

    ``frames`` has source_ordinal, local_episode, frame_index and, if ``tasks``
    (source_ordinal, local_index, task) is given, local_task.  The maps have a
    row for each episode or task and are broadcast while they are few.
    """
    placed = merged_episodes(episodes).select("source_ordinal", "local_episode", "episode_index", "dataset_from_index")
    if placed.limit(check_size + 1).count() <= check_size:
        placed = F.broadcast(placed)
    out = frames.join(placed, ["source_ordinal", "local_episode"]).withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index")
    if tasks is not None:
        known = merged_task_dictionary(tasks).select("source_ordinal", F.col("local_index").alias("local_task"), "task_index")
        out = out.join(known, ["source_ordinal", "local_task"]).drop("local_task")
    return out


def contributions(episodes: DataFrame) -> DataFrame:
    """Episodes and frames of each source."""
    return episodes.groupBy("source_ordinal").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"))
