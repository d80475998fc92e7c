"""Episodes that keep arriving: a file stream folded into per-episode statistics.

The engine's data are bounded; this is for folders that are still being filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.stats import scalar_stats


def arriving_frames(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Frames of Parquet files as they appear; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_statistics(frames: DataFrame, value: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's statistics by episode; parts of an episode merge on reading (merge_moments by episode)."""

    def fold(batch: DataFrame, number: int) -> None:
        stats = scalar_stats(batch, ["episode_index"], value)
        # a batch that is run again replaces its own part
        stats.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return frames.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
