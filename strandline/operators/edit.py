"""Edits of a dataset: deletion with renumbering, relabelling, dropped features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import dense_rank_of, running_offsets

SYSTEM_COLUMNS = ("timestamp", "frame_index", "episode_index", "index", "task_index")
#: Most episodes that one range of a selection may name.
RANGE_LIMIT = 10_000_000


def episode_selection(text: str) -> list[int]:
    """Episodes named by ``1,4,10:15``; ranges are half-open, ids not negative; sorted, each once."""
    chosen: set[int] = set()
    for part in text.split(","):
        first, colon, last = part.strip().partition(":")
        if not first.isdigit() or (colon and not last.isdigit()):
            raise ValueError(f"not an episode or a range: {part.strip()!r}")
        if not colon:
            chosen.add(int(first))
            continue
        a, b = int(first), int(last)
        if b <= a:
            raise ValueError(f"an empty range: {part.strip()!r}")
        if b - a > RANGE_LIMIT:
            raise ValueError(f"a range of more than {RANGE_LIMIT} episodes: {part.strip()!r}")
        chosen.update(range(a, b))
    return sorted(chosen)


def surviving_episodes(episodes: DataFrame, deleted: DataFrame, *, episode: str = "episode_index") -> DataFrame:
    """Episodes that are not deleted, with ``new_episode`` and ``new_from``: dense ranks and new offsets."""
    kept = episodes.join(deleted.select(episode).distinct(), episode, "left_anti")
    ranked = dense_rank_of(kept, episode, "new_episode")
    return running_offsets(ranked, episode, "length", start="new_from", stop="new_to")


def delete_episodes(frames: DataFrame, survivors: DataFrame, *, episode: str = "episode_index", frame: str = "frame_index") -> DataFrame:
    """Frames of the survivors with episode and global index renumbered; one equi-join, broadcast while it is small."""
    placed = survivors.select(episode, "new_episode", "new_from")
    out = frames.join(placed, episode)
    return out.withColumn(episode, F.col("new_episode")).withColumn("index", F.col("new_from") + F.col(frame)).drop("new_episode", "new_from")


def relabelled_tasks(tasks: DataFrame, overrides: DataFrame, *, episode: str = "episode_index") -> tuple[DataFrame, DataFrame]:
    """(dictionary, override by episode) after a relabelling.

    A new text that the dictionary has takes its lowest index; other texts are
    appended in the order of the first episode that they relabel.  Tasks that
    are no longer used stay.
    """
    from .index import task_dictionary

    lowest = tasks.groupBy("task").agg(F.min("task_index").alias("task_index"))
    fresh = overrides.join(lowest.select("task"), "task", "left_anti")
    numbered = task_dictionary(fresh, "task", [episode])
    base = tasks.agg((F.coalesce(F.max("task_index"), F.lit(-1)) + 1).alias("__base"))
    appended = numbered.crossJoin(F.broadcast(base)).select("task", (F.col("task_index") + F.col("__base")).alias("task_index"))
    return tasks.select("task", "task_index").unionByName(appended), overrides.join(lowest.unionByName(appended), "task").select(episode, F.col("task_index").alias("__new_task"))


def relabel(frames: DataFrame, override: DataFrame, *, episode: str = "episode_index") -> DataFrame:
    """Replaces the task of every frame of the named episodes and leaves the others as they are."""
    return frames.join(override, episode, "left").withColumn("task_index", F.coalesce("__new_task", "task_index")).drop("__new_task")


def drop_features(frames: DataFrame, names: list[str]) -> DataFrame:
    """Drops columns; unknown names and system columns are errors."""
    if unknown := sorted(set(names) - set(frames.columns)):
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    if system := sorted(set(names) & set(SYSTEM_COLUMNS)):
        raise ValueError(f"system columns cannot be dropped: {', '.join(system)}")
    return frames.select(*(F.col(f"`{c}`") for c in frames.columns if c not in names))


def canonical(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts the declared columns to their types; the others pass."""
    return df.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))
