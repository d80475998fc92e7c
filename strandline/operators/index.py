"""Generated columns and renumbering: offsets, row numbers, dictionaries, splits.

Running sums over episodes are windows over one small row for each episode, in
blocks: sums of blocks of the order key first, then a window within each block,
so no task sees all episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Consecutive order keys that share a block.
BLOCK = 10_000


def _block(key: Column) -> Column:
    return F.floor(key / F.lit(BLOCK)).cast("bigint")


def running_offsets(episodes: DataFrame, key: str, size: str, *, start: str = "dataset_from_index", stop: str = "dataset_to_index") -> DataFrame:
    """Adds the exclusive and inclusive running sums of ``size`` by ``key``.

    Blocks of BLOCK consecutive keys are summed first; only their sums, one
    row for BLOCK keys, meet in one window.
    """
    blocked = episodes.withColumn("__block", _block(F.col(key)))
    sums = blocked.groupBy("__block").agg(F.sum(size).alias("__sum"))
    before = sums.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocked.withColumn("__upto", F.sum(size).over(inside)).join(before, "__block")
    return out.withColumn(start, (F.col("__before") + F.col("__upto") - F.col(size)).cast("bigint")).withColumn(stop, (F.col("__before") + F.col("__upto")).cast("bigint")).drop("__block", "__upto", "__before")


def dense_rank_of(episodes: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers the rows from 0 in the order of a unique integer ``key``."""
    ranked = running_offsets(episodes.withColumn("__one", F.lit(1)), key, "__one", start=name, stop="__stop")
    return ranked.drop("__one", "__stop")


def generated_columns(frames: DataFrame, episodes: DataFrame, *, episode: str, order: list[str], fps: float, task: Column | None = None) -> DataFrame:
    """timestamp, frame_index, episode_index, index and task_index for frames of numbered episodes.

    ``episodes`` has the episode key, ``episode_index`` and ``dataset_from_index``.
    """
    within = Window.partitionBy(episode).orderBy(*order)
    numbered = frames.withColumn("frame_index", (F.row_number().over(within) - 1).cast("bigint"))
    placed = numbered.join(episodes.select(episode, "episode_index", "dataset_from_index"), episode)
    out = placed.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).withColumn("timestamp", (F.col("frame_index") / F.lit(float(fps))).cast("float")).drop("dataset_from_index")
    return out.withColumn("task_index", (F.lit(0) if task is None else task).cast("bigint"))


def task_dictionary(rows: DataFrame, task: str, order: list[str]) -> DataFrame:
    """(task, task_index): distinct texts numbered by first appearance.

    Partial aggregation has reduced the texts to one row each.  If the first
    order column is a whole number they are numbered in blocks of it.
    """
    first = rows.groupBy(task).agg(F.min(F.struct(*order)).alias("__first"))
    if not isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return first.select(task, (F.row_number().over(Window.orderBy("__first")) - 1).cast("bigint").alias("task_index"))
    blocked = first.withColumn("__block", _block(F.col("__first")[order[0]]))
    sums = blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("__sum"))
    before = sums.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__block").orderBy("__first")) - 1
    return blocked.withColumn("__at", within).join(before, "__block").select(task, (F.col("__before") + F.col("__at")).cast("bigint").alias("task_index"))


def merged_task_dictionary(tasks: DataFrame) -> DataFrame:
    """(source_ordinal, local_index, task, task_index) from the sources' dictionaries.

    Sources are taken in order and their tasks by local index; equal texts share
    the index of the first.
    """
    merged = task_dictionary(tasks, "task", ["source_ordinal", "local_index"])
    return tasks.join(merged, "task").select("source_ordinal", "local_index", "task", "task_index")


def subset(frames: DataFrame, start: int, stop: int, *, episode: str = "episode_index", index: str = "index") -> DataFrame:
    """Episodes start to stop - 1, renumbered from 0, with the global index rebased.

    The filter is on the episode, so row groups outside the range are not read.
    """
    kept = frames.where((F.col(episode) >= start) & (F.col(episode) < stop))
    base = kept.agg(F.min(index).alias("__base"))
    return kept.crossJoin(F.broadcast(base)).withColumn(episode, F.col(episode) - F.lit(start)).withColumn(index, F.col(index) - F.col("__base")).drop("__base")


def remap_splits(splits: DataFrame, survivors: DataFrame, *, episode: str = "episode_index") -> DataFrame:
    """Named half-open ranges over old episodes as ranges over the survivors.

    Edges are few; each task counts the survivors below every edge and one row
    for each split is shuffled.
    """
    counted = survivors.join(F.broadcast(splits), F.lit(True), "inner").groupBy("split").agg(F.sum((F.col(episode) < F.col("start")).cast("bigint")).alias("start"), F.sum((F.col(episode) < F.col("stop")).cast("bigint")).alias("stop"))
    return splits.select("split").join(counted, "split", "left").select("split", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", F.lit(0)).alias("stop"))


def location(number: Column, per_chunk: int) -> tuple[Column, Column]:
    """(chunk, file) of a running number."""
    return F.floor(number / F.lit(per_chunk)).cast("bigint"), F.pmod(number, F.lit(per_chunk)).cast("bigint")


def islands(keys: DataFrame, key: str) -> DataFrame:
    """Maximal runs of consecutive integers as half-open (start, stop).

    A run begins where the key before is missing and ends where the key after
    is.  Neighbours are found in blocks of keys, whose last and first keys tell
    the blocks beside them; only rows where runs begin or end are numbered.
    """
    blocked = keys.select(F.col(key).cast("bigint").alias("k")).distinct().withColumn("__block", _block(F.col("k")))
    edges = blocked.groupBy("__block").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    # a run goes on into the next block only if that begins where this one ends
    along = Window.orderBy("__block")
    edges = edges.select("__block", F.lag("hi").over(along).alias("__before"), F.lead("lo").over(along).alias("__after"))
    within = Window.partitionBy("__block").orderBy("k")
    flagged = blocked.withColumn("__p", F.lag("k").over(within)).withColumn("__q", F.lead("k").over(within)).join(edges, "__block")
    begins = F.coalesce(F.coalesce("__p", "__before") < F.col("k") - 1, F.lit(True))
    ends = F.coalesce(F.coalesce("__q", "__after") > F.col("k") + 1, F.lit(True))
    marks = flagged.select("k", begins.cast("int").alias("b"), ends.alias("e")).where((F.col("b") == 1) | F.col("e"))
    numbered = running_offsets(marks, "k", "b", start="__s", stop="n")
    return numbered.groupBy("n").agg(F.min("k").alias("start"), (F.max("k") + 1).alias("stop")).select("start", "stop")


def contiguity(frames: DataFrame, episode: str, frame: str) -> DataFrame:
    """For each episode: rows, and whether the frame numbers are 0 to rows - 1, each once."""
    return frames.groupBy(episode).agg(F.count(F.lit(1)).alias("length"), ((F.min(frame) == 0) & (F.max(frame) == F.count(F.lit(1)) - 1) & (F.count_distinct(F.col(frame)) == F.count(F.lit(1)))).alias("contiguous"))


def media_offsets(files: DataFrame, *, camera: str, file: str, order: str, duration: str) -> DataFrame:
    """from_timestamp and to_timestamp of each episode's slice within its media file."""
    upto = Window.partitionBy(camera, file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(duration).over(upto)
    return files.withColumn("to_timestamp", stop).withColumn("from_timestamp", F.col("to_timestamp") - F.col(duration))


def first_offset(episodes: DataFrame, *, chunk: str, file: str, start: str = "dataset_from_index") -> DataFrame:
    """Adds row_start: how far an episode's rows are into their file."""
    return episodes.withColumn("row_start", F.col(start) - F.min(start).over(Window.partitionBy(chunk, file)))
