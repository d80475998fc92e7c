"""What Parquet footers tell: rows, stored bytes and bytes before compression, read in tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import formatted, q
from ..model import V21_DATA, V30_DATA, Dataset
from . import files, stores


def file_footers(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, rows, stored, logical) of every file named; a file that is not there has nulls."""

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for name in batch["path"]:
                stored = stores.size(name)
                if stored is None:
                    out.append((name, None, None, None))
                    continue
                with stores.reader(name) as file:
                    meta = pq.read_metadata(file)
                logical = sum(meta.row_group(g).column(c).total_uncompressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
                out.append((name, meta.num_rows, stored, logical))
            yield pd.DataFrame(out, columns=["path", "rows", "stored", "logical"]).astype({"rows": "Int64", "stored": "Int64", "logical": "Int64"})

    spark = paths.sparkSession
    named = paths.select(q(path).alias("path")).distinct().repartition(2 * spark.sparkContext.defaultParallelism, "path")
    return named.mapInPandas(run, "path string, rows bigint, stored bigint, logical bigint")


def episode_files(spark: SparkSession, data: Dataset) -> DataFrame:
    """(episode_index, length, path): the data file of each episode, by its whole path."""
    base = files.qualified(spark, data.root)
    if data.info.version == "v2.1":
        chunk = F.floor(F.col("episode_index") / data.info.chunks_size)
        path = formatted(f"{base}/{V21_DATA}", episode_chunk=chunk, episode_index=F.col("episode_index"))
        return data.episodes.select("episode_index", "length", path.alias("path"))
    wide = spark.read.option("recursiveFileLookup", "true").parquet(f"{data.root}/meta/episodes")
    path = formatted(f"{base}/{V30_DATA}", chunk_index=q("data/chunk_index"), file_index=q("data/file_index"))
    return wide.select("episode_index", "length", path.alias("path"))


def data_profile(spark: SparkSession, data: Dataset) -> DataFrame:
    """(episode_index, length, path, rows, stored, logical, share): a file's figures, and the episode's share of its stored bytes.

    The share is by rows, rounded to even, one byte at least.
    """
    placed = episode_files(spark, data)
    told = placed.join(file_footers(placed), "path")
    share = F.greatest(F.lit(1), F.bround(F.col("stored") * F.col("length") / F.greatest(F.col("rows"), F.lit(1)), 0).cast("bigint"))
    return told.select("episode_index", "length", "path", "rows", "stored", "logical", share.alias("share"))
