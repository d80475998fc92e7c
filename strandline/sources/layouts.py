"""Readers of the two Parquet layouts.

v2.1 has a Parquet file for each episode and JSON lines as metadata; v3.0 packs
episodes into shards and keeps episode metadata as a wide Parquet table.  Both
become the same frames, episodes and tasks.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import formatted, q
from ..functions.statmaps import nest_stats
from ..model import V21_VIDEO, V30_VIDEO, Dataset, Info, normalize_version, video_slice
from ..operators.index import running_offsets
from ..schema import Feature, canonical_types
from . import files
from .registry import SourceProvider


def read_info(spark: SparkSession, root: str) -> Info:
    raw = files.read_json(spark, f"{root}/meta/info.json")
    features = {k: Feature.of(v) for k, v in raw["features"].items()}
    return Info(normalize_version(raw["codebase_version"]), raw["fps"], features, raw.get("robot_type"), dict(raw.get("splits") or {}), raw.get("chunks_size", 1000), raw.get("data_path"), raw.get("video_path"), raw)


def _widest(kind: T.DataType) -> T.DataType:
    """The type that every stored width of a number can be read as."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_widest(kind.elementType))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return T.DoubleType()
    return T.LongType() if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) else kind


def _frames(spark: SparkSession, root: str, info: Info, listed: bool) -> DataFrame:
    """Frames cast to the declared types, whatever width each file stores; no rows, but their columns, if they are not ``listed``.

    One scan of all files: numbers are read at their widest and cast, which the
    Parquet reader does by column; columns and filters still reach the scan.
    One file tells the columns, so the files are listed once, by the scan.
    """
    one = files.first_file(spark, f"{root}/data", ".parquet")
    target = canonical_types(spark.read.parquet(one or f"{root}/data").schema, info.features)
    wide = T.StructType([T.StructField(f.name, _widest(f.dataType)) for f in target.fields])
    rows = spark.read.option("recursiveFileLookup", "true").schema(wide).parquet(f"{root}/data") if listed else spark.createDataFrame([], wide)
    return rows.select(*(q(f.name).cast(f.dataType).alias(f.name) for f in target.fields))


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_v21(spark: SparkSession, root: str, *, frames: bool = True) -> Dataset:
    info = read_info(spark, root)
    tasks = _jsonl(spark, f"{root}/meta/tasks.jsonl", "task_index bigint, task string")
    lines = spark.read.text(f"{root}/meta/episodes.jsonl")
    episodes = lines.select(F.from_json("value", "episode_index bigint, length bigint, tasks array<string>").alias("e"), F.col("value").alias("extra_json")).select("e.*", "extra_json")
    stats_path = f"{root}/meta/episodes_stats.jsonl"
    if files.exists(spark, stats_path):
        stats = spark.read.text(stats_path).select(F.get_json_object("value", "$.episode_index").cast("bigint").alias("episode_index"), F.get_json_object("value", "$.stats").alias("stats_json"))
        episodes = episodes.join(stats, "episode_index", "left")
    else:
        episodes = episodes.withColumn("stats_json", F.lit(None).cast("string"))
    placed = running_offsets(episodes, "episode_index", "length").drop("dataset_to_index")
    base = files.qualified(spark, root)
    chunk = F.floor(F.col("episode_index") / info.chunks_size)
    path = lambda k: formatted(f"{base}/{(info.video_path or V21_VIDEO)}", video_key=k, episode_chunk=chunk, episode_index=F.col("episode_index"))
    videos = F.array(*(video_slice(k, path(k), F.lit(0.0), F.col("length") / F.lit(float(info.fps))) for k in info.cameras))
    listed = F.to_json(videos) if info.cameras else F.lit("[]")
    return Dataset(info, _frames(spark, root, info, frames), placed.withColumn("videos_json", listed), tasks, root)


def read_v30(spark: SparkSession, root: str, *, frames: bool = True) -> Dataset:
    info = read_info(spark, root)
    tasks = spark.read.parquet(f"{root}/meta/tasks.parquet").select("task_index", "task")
    wide = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    nested = nest_stats(wide.columns)
    per_feature = [F.struct(*(q(c).alias(k) for k, c in sorted(keys.items()))).alias(f) for f, keys in sorted(nested.items())]
    stats = F.to_json(F.struct(*per_feature)) if per_feature else F.lit(None).cast("string")
    base = files.qualified(spark, root)
    at = lambda k, field: q(f"videos/{k}/{field}")
    path = lambda k: formatted(f"{base}/{(info.video_path or V30_VIDEO)}", video_key=k, chunk_index=at(k, "chunk_index"), file_index=at(k, "file_index"))
    made = [F.when(at(k, "chunk_index").isNotNull(), video_slice(k, path(k), at(k, "from_timestamp"), at(k, "to_timestamp"))) for k in info.cameras if f"videos/{k}/chunk_index" in wide.columns]
    videos = F.to_json(F.array_compact(F.array(*made))) if made else F.lit("[]")
    known = {"episode_index", "length", "tasks", "dataset_from_index", "dataset_to_index"}
    extra = [q(c) for c in wide.columns if c not in known and "/" not in c]
    episodes = wide.select("episode_index", "length", "tasks", "dataset_from_index", stats.alias("stats_json"), videos.alias("videos_json"), (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("extra_json"))
    return Dataset(info, _frames(spark, root, info, frames), episodes, tasks, root)


def open_dataset(spark: SparkSession, root: str, *, frames: bool = True) -> Dataset:
    """Reads a dataset of either layout, as its metadata says.

    Who asks for metadata only says so: without ``frames`` there are their
    columns but no rows, and the driver does not list the data files.
    """
    version = normalize_version(files.read_json(spark, f"{root}/meta/info.json")["codebase_version"])
    return (read_v21 if version == "v2.1" else read_v30)(spark, root, frames=frames)


class LayoutProvider(SourceProvider):
    """Both Parquet layouts, told apart by their metadata."""

    name = "lerobot"
    aliases = ("auto",)

    def open(self, spark: SparkSession, root: str, config: Any = None) -> Dataset:
        return open_dataset(spark, root)


def stats_of(text: str | None) -> dict[str, dict[str, Any]]:
    return json.loads(text) if text else {}
