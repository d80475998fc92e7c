"""Writers of both layouts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import formatted
from ..model import V21_DATA, V21_VIDEO, V30_DATA, V30_VIDEO, VIDEO_SLICES, Dataset
from ..operators.index import location, running_offsets
from ..operators.pack import greedy_pack
from ..operators.stats import merge_moments, quantile_envelope
from ..sources import files, stores
from ..sources.footers import data_profile
from ..sources.layouts import stats_of
from .shards import many_tasks, write_files

_QUANTILE = re.compile(r"q\d+")
#: Defaults of a conversion.
DATA_MB = 100


def _stream_lines(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """One file with a row's ``line`` after the other, by ``key``: one task sorts and writes them as a stream, the driver sees none."""
    target = files.qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fill(out: BinaryIO) -> None:
            for batch in batches:
                out.write("".join(line + "\n" for line in batch.column(0).to_pylist()).encode())

        stores.write(target, TaskContext.get().taskAttemptId(), fill)
        yield from ()

    rows.repartition(1).sortWithinPartitions(key).select("line").mapInArrow(run, "line string").count()
    if not files.exists(spark, path):  # no rows may mean no task
        files.write_text(spark, path, "")


def _info(data: Dataset, version: str, totals: dict[str, int], **more: Any) -> dict[str, Any]:
    info = data.info
    out = dict(info.raw)
    out.pop("total_chunks", None)
    out |= {"codebase_version": version, "robot_type": info.robot_type, "fps": info.fps, "splits": info.splits, "features": {k: f.to_json() for k, f in info.features.items()}, "chunks_size": info.chunks_size} | totals | more
    return out


def _totals(data: Dataset) -> dict[str, int]:
    row = data.episodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("f")).first()
    return {"total_episodes": row["n"], "total_frames": row["f"], "total_tasks": data.tasks.count()}


def write_v21(data: Dataset, root: str) -> None:
    """A Parquet file for each episode, JSON lines as metadata; statistics are carried over."""
    spark = data.frames.sparkSession
    size = data.info.chunks_size
    chunk = F.floor(F.col("episode_index") / size)
    named = data.frames.withColumn("__path", formatted(V21_DATA, episode_chunk=chunk, episode_index=F.col("episode_index")))
    written = write_files(named, path=root, order=["frame_index"], features=data.info.features, tasks=many_tasks(spark))
    n_files = written.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    totals = _totals(data)
    if n_files != totals["total_episodes"]:
        raise ValueError(f"{totals['total_episodes']} episodes, but frames of {n_files}")
    stats = F.concat(F.lit('{"episode_index": '), F.col("episode_index").cast("string"), F.lit(', "stats": '), "stats_json", F.lit("}"))
    _stream_lines(spark, f"{root}/meta/tasks.jsonl", data.tasks.select("task_index", F.to_json(F.struct("task_index", "task")).alias("line")), "task_index")
    _stream_lines(spark, f"{root}/meta/episodes.jsonl", data.episodes.select("episode_index", F.to_json(F.struct("episode_index", "tasks", "length")).alias("line")), "episode_index")
    _stream_lines(spark, f"{root}/meta/episodes_stats.jsonl", data.episodes.where("stats_json is not null").select("episode_index", stats.alias("line")), "episode_index")
    files.write_json(spark, f"{root}/meta/info.json", _info(data, "v2.1", totals | {"total_videos": totals["total_episodes"] * len(data.info.cameras), "total_chunks": -(-totals["total_episodes"] // size)}, data_path=V21_DATA, video_path=V21_VIDEO if data.info.cameras else None))


#: Bytes of each leaf type, before compression.
_BYTES = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4}


def row_bytes(data: Dataset) -> int:
    """Bytes of one frame by its declared features."""
    return max(1, sum(_BYTES.get(f.dtype, 8) * math.prod(f.shape or (1,)) for f in data.info.features.values() if not f.is_media))


def episode_sizes(data: Dataset) -> DataFrame:
    """(episode_index, length, bytes): stored bytes of each episode, its file's shared by rows.

    A dataset that lies nowhere as it is (an edit, a merge, computed frames) is
    sized by its lengths and its features.
    """
    if data.root is None:
        return data.episodes.select("episode_index", "length", (F.greatest(F.lit(1), F.col("length") * F.lit(row_bytes(data)))).cast("bigint").alias("bytes"))
    return data_profile(data.frames.sparkSession, data).select("episode_index", "length", F.col("share").alias("bytes"))


_MOMENTS = ("min", "max", "mean", "std")


def _envelope(long: DataFrame) -> dict[tuple[str, str], float]:
    """Value of each (feature|component, quantile) that every owner has."""
    key = F.concat_ws("|", "feature", "component")
    every = long.select("episode_index", key.alias("key"), F.explode("quantiles").alias("quantile", "value"))
    whole = long.select("episode_index", key.alias("key"), F.lit("").alias("quantile"), F.lit(0.0).alias("value"))  # episodes without quantiles count as owners too
    found = quantile_envelope(every.unionByName(whole), "key", "quantile", "value", "episode_index").where("quantile <> ''").collect()
    return {(r["key"], r["quantile"]): r["value"] for r in found}


def aggregate_stats(episodes: DataFrame) -> dict[str, dict[str, Any]]:
    """Dataset-wide statistics from the episodes' own: merged in Spark, a row for each component comes back.

    Moments are those of the union.  Quantiles (q05 and the like) that every
    episode has become an envelope: the least up to the median, the greatest above.
    The texts are parsed once: their components are kept while both are made.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for episode, text in zip(batch["episode_index"], batch["stats_json"], strict=True):
                for feature, s in stats_of(text).items():
                    if not all(k in s for k in (*_MOMENTS, "count")):
                        continue
                    shape, count = json.dumps(_shape(s["mean"])), int(_flat(s["count"])[0])
                    quantiles = sorted(k for k in s if _QUANTILE.fullmatch(k))
                    columns = [_flat(s[k]) for k in (*_MOMENTS, *quantiles)]
                    out += [(int(episode), feature, shape, i, *map(float, v[:4]), count, dict(zip(quantiles, map(float, v[4:]), strict=True))) for i, v in enumerate(zip(*columns, strict=True))]
            yield pd.DataFrame(out, columns=["episode_index", "feature", "shape", "component", *_MOMENTS, "count", "quantiles"])

    long = episodes.select("episode_index", "stats_json").where("stats_json is not null").mapInPandas(rows, "episode_index bigint, feature string, shape string, component int, min double, max double, mean double, std double, count bigint, quantiles map<string,double>").persist(StorageLevel.MEMORY_AND_DISK)
    merged = merge_moments(long, ["feature", "shape", "component"]).orderBy("feature", "component").collect()
    envelope = _envelope(long) if long.where(F.size("quantiles") > 0).limit(1).count() else {}
    long.unpersist()
    quantiles = sorted({k for _, k in envelope})
    out: dict[str, dict[str, Any]] = {}
    for r in merged:
        entry = out.setdefault(r["feature"], {k: [] for k in _MOMENTS} | {"count": [r["count"]], "__shape": json.loads(r["shape"])})
        for k in _MOMENTS:
            entry[k].append(r[k])
        for k in quantiles:
            if (value := envelope.get((f"{r['feature']}|{r['component']}", k))) is not None:
                entry.setdefault(k, []).append(value)
    for entry in out.values():
        shape = entry.pop("__shape")
        for k in entry.keys() - {"count"}:
            entry[k] = _nested(entry[k], shape)
    return out


def _flat(value: Any) -> list[float]:
    return [x for v in value for x in _flat(v)] if isinstance(value, list) else [value]


def _shape(value: Any) -> list[int]:
    return [len(value), *(_shape(value[0]) if value else [])] if isinstance(value, list) else []


def _nested(flat: list[float], shape: list[int]) -> Any:
    if len(shape) <= 1:
        return flat if shape else flat[0]
    step = len(flat) // shape[0]
    return [_nested(flat[i * step : (i + 1) * step], shape[1:]) for i in range(shape[0])]


def write_v30(data: Dataset, root: str, *, data_mb: float = DATA_MB, video_mb: float | None = None) -> None:
    """Shards of up to ``data_mb`` MiB, wide episode metadata and merged statistics."""
    spark = data.frames.sparkSession
    per_chunk = data.info.chunks_size
    packed = greedy_pack(episode_sizes(data), key="episode_index", size="bytes", limit=int(data_mb * (1 << 20)))
    # footers are read once: where each episode goes is kept while shards and metadata are written
    placed = running_offsets(packed.select("episode_index", "length", "file_index"), "episode_index", "length").persist(StorageLevel.MEMORY_AND_DISK)
    chunk, file = location(F.col("file_index"), per_chunk)
    named = data.frames.drop("index").join(placed.select("episode_index", "file_index", "dataset_from_index"), "episode_index").withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    named = named.withColumn("__path", formatted(V30_DATA, chunk_index=chunk, file_index=file)).select(*(F.col(f"`{c}`") for c in data.frames.columns), "__path")
    write_files(named, path=root, order=["index"], features=data.info.features).agg(F.sum("rows")).first()
    rows = data.episodes.select("episode_index", "tasks", "stats_json", "videos_json").join(placed, "episode_index").select("*", chunk.alias("chunk"), file.alias("file"))
    write_files(episode_table(rows, data.info.cameras), path=root, order=["episode_index"], features={}).agg(F.sum("rows")).first()
    placed.unpersist()
    listed = data.tasks.orderBy("task_index").collect()
    tasks = pd.DataFrame({"task_index": [r["task_index"] for r in listed]}, index=pd.Index([r["task"] for r in listed], name="task"))
    _put_table(spark, f"{root}/meta/tasks.parquet", pa.Table.from_pandas(tasks))
    files.write_json(spark, f"{root}/meta/stats.json", aggregate_stats(data.episodes))
    sizes = {"data_files_size_in_mb": data_mb} | ({"video_files_size_in_mb": video_mb} if video_mb else {})
    files.write_json(spark, f"{root}/meta/info.json", _info(data, "v3.0", _totals(data), data_path=V30_DATA, video_path=V30_VIDEO if data.info.cameras else None, **sizes))


def _put_table(spark: SparkSession, path: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    fs, target = files._path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(sink.getvalue().to_pybytes()))
    finally:
        out.close()


def _stat_columns(episodes: DataFrame) -> list[tuple[str, str, int]]:
    """(feature, statistic, nesting) of every statistic that any episode has; a row for each comes back."""

    def run(batches):
        for batch in batches:
            seen = {(f, k, len(_shape(v))) for text in batch["stats_json"] for f, s in stats_of(text).items() for k, v in s.items()}
            yield pd.DataFrame(sorted(seen), columns=["feature", "statistic", "depth"])

    found = episodes.select("stats_json").where("stats_json is not null").mapInPandas(run, "feature string, statistic string, depth int")
    return [tuple(r) for r in found.groupBy("feature", "statistic").agg(F.max("depth")).orderBy("feature", "statistic").collect()]


def _of_camera(name: str) -> Callable[[Column], Column]:
    return lambda v: v["camera"] == name


def episode_table(rows: DataFrame, cameras: list[str]) -> DataFrame:
    """The wide episode table with the file it goes to: by the layout's rule one file, written as a stream of batches."""
    columns = ["episode_index", F.col("chunk").alias("data/chunk_index"), F.col("file").alias("data/file_index"), "dataset_from_index", "dataset_to_index", "tasks", "length"]
    slices = F.from_json("videos_json", VIDEO_SLICES)
    for k in cameras:
        own = F.element_at(F.filter(slices, _of_camera(k)), 1)
        for i, name in ((1, "chunk_index"), (2, "file_index")):
            columns.append(F.regexp_extract(own["path"], r"chunk-(\d+)/file-(\d+)\.mp4$", i).try_cast("bigint").alias(f"videos/{k}/{name}"))
        columns += [own[name].alias(f"videos/{k}/{name}") for name in ("from_timestamp", "to_timestamp")]
    stats = _stat_columns(rows)
    if stats:
        by_feature: dict[str, list[str]] = {}
        for feature, statistic, depth in stats:
            leaf = "bigint" if statistic == "count" else "double"
            by_feature.setdefault(feature, []).append(f"`{statistic}`: " + "array<" * depth + leaf + ">" * depth)
        schema = "struct<" + ", ".join(f"`{f}`: struct<{', '.join(kinds)}>" for f, kinds in by_feature.items()) + ">"
        parsed = F.from_json("stats_json", schema)
        columns += [parsed[feature][statistic].alias(f"stats/{feature}/{statistic}") for feature, statistic, _ in stats]
    zero = F.lit(0).cast("bigint")
    return rows.select(*columns, zero.alias("meta/episodes/chunk_index"), zero.alias("meta/episodes/file_index"), F.lit("meta/episodes/chunk-000/file-000.parquet").alias("__path"))
