"""Whole-dataset operations: convert, merge, edit, subset, validate and compare."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import formatted, q
from ..model import V21_DATA, V30_DATA, Dataset, full_split, normalize_version, parse_split
from ..operators import compare as cmp
from ..operators import edit as ed
from ..operators.index import merged_task_dictionary, remap_splits, running_offsets, task_dictionary
from ..operators.merge import merged_episodes
from ..schema import leaf_of, nested_shape, normalized, repaired_shape
from ..sinks.layouts import write_v21, write_v30
from ..sinks.publish import check_paths, publish
from ..sources import files, stores
from ..sources.layouts import open_dataset, stats_of


@dataclass(frozen=True)
class Report:
    """Errors and warnings of a check."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def to_json(self) -> dict[str, Any]:
        return {"ok": self.ok, "errors": self.errors, "warnings": self.warnings}


def _data_files(spark: SparkSession, root: str, data: Dataset) -> DataFrame:
    """(path, rows): the files that the metadata names and the rows it promises."""
    if data.info.version == "v2.1":
        chunk = F.floor(F.col("episode_index") / data.info.chunks_size)
        return data.episodes.select(formatted(V21_DATA, episode_chunk=chunk, episode_index=F.col("episode_index")).alias("path"), F.col("length").alias("rows"))
    wide = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    path = formatted(V30_DATA, chunk_index=q("data/chunk_index"), file_index=q("data/file_index"))
    return wide.select(path.alias("path"), "length").groupBy("path").agg(F.sum("length").alias("rows"))


def file_faults(spark: SparkSession, root: str, data: Dataset) -> DataFrame:
    """(code, message) of data files that are missing or whose footers promise other rows; footers are read in tasks."""
    base = files.qualified(spark, root)

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for name, rows in zip(batch["path"], batch["rows"], strict=True):
                if not stores.exists(f"{base}/{name}"):
                    out.append(("missing_file", f"missing file {name}"))
                    continue
                with stores.reader(f"{base}/{name}") as file:
                    there = pq.read_metadata(file).num_rows
                if there != rows:
                    out.append(("file_rows", f"{name} has {there} rows, {rows} are expected"))
            yield pd.DataFrame(out, columns=["code", "message"])

    return _data_files(spark, root, data).repartition(2 * spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "code string, message string")


def depth_warnings(data: Dataset) -> list[str]:
    """Features whose declared shape nests otherwise than their column."""
    out = []
    for f in data.frames.schema.fields:
        declared = data.info.features.get(f.name)
        if declared is None or declared.dtype in ("image", "video"):
            continue
        depth = leaf_of(f.dataType)[1]
        if len(declared.shape) > 1 and depth != len(declared.shape):
            out.append(f"{f.name}: shape {list(declared.shape)} has {len(declared.shape)} dimensions, the column nests {depth}")
    return out


def validate(spark: SparkSession, root: str, *, deep: bool = False, limit: int = 50) -> Report:
    """Metadata against itself and the files, and with ``deep`` the frames and videos too; deep only where the rest is sound."""
    try:
        data = open_dataset(spark, root, frames=deep)
        whole = data.episodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("f"), F.min("episode_index").alias("a"), F.max("episode_index").alias("b"), F.count_distinct(F.col("episode_index")).alias("d"), F.count("stats_json").alias("s")).first()
    except Exception as e:  # noqa: BLE001  an unreadable dataset is a finding
        return Report([f"cannot be read: {e}"])
    raw, errors = data.info.raw, []
    if raw.get("total_episodes") not in (None, whole["n"]):
        errors.append(f"total_episodes is {raw['total_episodes']}, there are {whole['n']}")
    if whole["n"] and (whole["a"], whole["b"], whole["d"]) != (0, whole["n"] - 1, whole["n"]):
        errors.append("episode indices are not 0 to n - 1")
    if raw.get("total_frames") not in (None, whole["f"]):
        errors.append(f"total_frames is {raw['total_frames']}, lengths sum to {whole['f']}")
    if 0 < whole["s"] < whole["n"]:
        errors.append(f"{whole['n'] - whole['s']} of {whole['n']} episodes have no statistics")
    errors += [r["message"] for r in file_faults(spark, root, data).orderBy("code", "message").limit(limit).collect()]
    if data.info.cameras:
        from ..media.jobs import video_faults

        errors += [f"episode {r['episode_index']}: {r['message']}" for r in video_faults(data, deep=deep).orderBy("episode_index", "message").limit(limit).collect()]
    if deep and not errors:
        found = cmp.validation_errors(data.frames, data.episodes).orderBy("episode_index").limit(limit).collect()
        errors += [f"{r['code']} in episode {r['episode_index']}: {r['message']}" for r in found]
        if data.info.version == "v2.1" and not errors:
            errors += _misplaced(spark, root, limit)
    return Report(errors[:limit], depth_warnings(data))


def _misplaced(spark: SparkSession, root: str, limit: int) -> list[str]:
    """Files of one episode that hold frames of another."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data").select("episode_index", F.regexp_extract(F.col("_metadata.file_name"), r"episode_(\d+)\.parquet$", 1).try_cast("bigint").alias("named"))
    found = rows.where(~F.col("episode_index").eqNullSafe(F.col("named"))).groupBy("named").agg(F.count(F.lit(1)).alias("n")).orderBy("named").limit(limit).collect()
    return [f"episode_index in the file of episode {r['named']}: {r['n']} frames name another" for r in found]


def compare(left: Dataset, right: Dataset, *, check_data: bool = True, check_videos: bool = False, limit: int = 50, nan_equal: bool = False) -> Report:
    """Whether two datasets say the same, whatever their layout: metadata, tasks, episodes, statistics, frames, video packets."""
    errors = []
    if left.info.fps != right.info.fps:
        errors.append(f"fps: {left.info.fps} and {right.info.fps}")
    a, b = normalized(repaired(left).info.features), normalized(repaired(right).info.features)
    errors += [f"feature {k} differs" for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
    kinds = [{f.name: f.dataType.simpleString() for f in x.frames.schema.fields} for x in (left, right)]
    errors += [f"column {k}: {kinds[0].get(k)} and {kinds[1].get(k)}" for k in sorted(kinds[0].keys() | kinds[1].keys()) if kinds[0].get(k) != kinds[1].get(k)]
    tasks = cmp.compare_frames(left.tasks, right.tasks, ["task_index"]).where("status <> 'same'").orderBy("task_index").limit(limit).collect()
    errors += [f"task {r['task_index']}: {r['status']}" for r in tasks]
    pick = ["episode_index", "length", "tasks"]
    episodes = cmp.compare_frames(left.episodes.select(*pick), right.episodes.select(*pick), ["episode_index"]).where("status <> 'same'").orderBy("episode_index").limit(limit).collect()
    errors += [f"episode {r['episode_index']}: {r['status']}" for r in episodes]
    if not errors:
        errors += _stats_errors(left.episodes, right.episodes, limit)
    if check_data and not errors:
        names = sorted(left.frames.columns)
        diff = cmp.compare_frames(left.frames.select(*(q(c) for c in names)), right.frames.select(*(q(c) for c in names)), ["episode_index", "frame_index"], tolerant=False, nan_equal=nan_equal)
        found = diff.where("status <> 'same'").groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).orderBy("episode_index").limit(limit).collect()
        errors += [f"episode {r['episode_index']}: {r['n']} frames differ" for r in found]
    if check_videos and not errors:
        from ..media.jobs import video_digests

        diff = cmp.compare_frames(video_digests(left), video_digests(right), ["episode_index", "camera"])
        found = diff.where("status <> 'same'").orderBy("episode_index", "camera").limit(limit).collect()
        errors += [f"episode {r['episode_index']}, {r['camera']}: video {r['status']}" for r in found]
    return Report(errors[:limit])


def _close(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, int | float) and isinstance(b, int | float):
        return abs(a - b) <= 1e-7 + 1e-6 * abs(b)
    return a == b


def _stats_errors(left: DataFrame, right: DataFrame, limit: int) -> list[str]:
    both = left.select("episode_index", F.col("stats_json").alias("a")).join(right.select("episode_index", F.col("stats_json").alias("b")), "episode_index")

    def run(batches):
        for batch in batches:
            bad = [not _close(stats_of(a), stats_of(b)) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[bad, ["episode_index"]]

    found = both.mapInPandas(run, "episode_index bigint").orderBy("episode_index").limit(limit).collect()
    return [f"episode {r['episode_index']}: statistics differ" for r in found]


@dataclass(frozen=True)
class Output:
    """How a dataset is written: sizes of packed files in MiB, and whether the result's frames are checked too."""

    data_mb: float = 100
    video_mb: float = 200
    overwrite: bool = False
    deep: bool = False


def _write(data: Dataset, root: str, version: str, output: Output) -> None:
    data = repaired(data)
    spark = data.frames.sparkSession
    if data.info.cameras:
        from ..media.jobs import copy_media, mux_pictures

        muxed = f"{root}/.muxed"
        if data.pictures is not None:
            data = mux_pictures(data, muxed)
        data = copy_media(data, root, version, video_mb=output.video_mb)
        files.delete(spark, muxed)
    if version == "v2.1":
        write_v21(data, root)
    else:
        write_v30(data, root, data_mb=output.data_mb, video_mb=output.video_mb if data.info.cameras else None)


def _publish(spark: SparkSession, data: Dataset, destination: str, version: str, output: Output) -> None:
    def build(staging: str) -> None:
        # the episode table is asked several times: a row for each episode is kept, and made again where it is lost
        episodes, tasks = data.episodes.persist(StorageLevel.MEMORY_AND_DISK), data.tasks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _write(data.with_(episodes=episodes, tasks=tasks), staging, version, output)
        finally:
            episodes.unpersist()
            tasks.unpersist()
        report = validate(spark, staging, deep=output.deep)
        if not report.ok:
            raise ValueError("the result is not valid: " + "; ".join(report.errors[:5]))

    publish(spark, destination, build, overwrite=output.overwrite)


def convert(spark: SparkSession, source: str | Dataset, destination: str, target_version: str, *, data_mb: float = 100, video_mb: float = 200, overwrite: bool = False, deep: bool = False, dry_run: bool = False) -> dict[str, Any]:
    """Writes a dataset in the other layout; frames, statistics, tasks and videos are carried over."""
    data = open_dataset(spark, source) if isinstance(source, str) else source
    version = normalize_version(target_version)
    if isinstance(source, str):
        check_paths(spark, destination, [source])
        if data.info.version == version:
            raise ValueError(f"the source is {version} already")
    if not dry_run:
        data = data.with_(episodes=data.episodes.persist(StorageLevel.MEMORY_AND_DISK))  # computed once for the figures and for the files
    n = data.episodes.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("f")).first()
    if not dry_run:
        _publish(spark, data, destination, version, Output(data_mb, video_mb, overwrite, deep))
    return {"destination": destination, "version": version, "episodes": n["n"], "frames": n["f"], "written": not dry_run}


def merge_check(spark: SparkSession, sources: list[str]) -> Report:
    """Whether datasets can be merged: two at least, all different, each whole, and alike in version, rate, robot, features and split."""
    if len(sources) < 2 or len({files.qualified(spark, s) for s in sources}) != len(sources):
        return Report(["a merge needs two different datasets at least"])
    errors, parts = [], []
    for s in sources:
        checked = validate(spark, s)
        errors += [f"{s}: {e}" for e in checked.errors]
        if checked.ok:
            parts.append((s, open_dataset(spark, s)))
    if errors:
        return Report(errors)
    first, splits = parts[0][1], {}
    for s, p in parts:
        for what in ("version", "fps", "robot_type"):
            if getattr(p.info, what) != getattr(first.info, what):
                errors.append(f"{s}: {what} differs from the first source")
        if normalized(repaired(p).info.features) != normalized(repaired(first).info.features):
            errors.append(f"{s}: features differ from the first source")
        try:
            splits[full_split(p.info, p.episodes.count())] = s
        except ValueError as e:
            errors.append(f"{s}: {e}")
    if len(splits) > 1:
        errors.append("the sources' splits have different names")
    return Report(errors)


def check_deletion(left: Dataset, right: Dataset, deleted: list[int], limit: int = 50) -> Report:
    """Whether ``right`` is ``left`` without the deleted episodes: survivors in order, and every column but the renumbered ones equal."""
    spark = left.frames.sparkSession
    gone = spark.createDataFrame([(k,) for k in deleted], "episode_index bigint")
    kept = ed.surviving_episodes(left.episodes.select("episode_index", "length"), gone)
    wanted = ed.delete_episodes(left.frames, kept)
    names = sorted(left.frames.columns)
    if names != sorted(right.frames.columns):
        return Report(["columns differ"])
    diff = cmp.compare_frames(wanted.select(*(q(c) for c in names)), right.frames.select(*(q(c) for c in names)), ["episode_index", "frame_index"], tolerant=False, nan_equal=True)
    found = diff.where("status <> 'same'").groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).orderBy("episode_index").limit(limit).collect()
    return Report([f"episode {r['episode_index']}: {r['n']} frames differ" for r in found])


def merge_datasets(spark: SparkSession, sources: list[str], destination: str, *, overwrite: bool = False, data_mb: float = 100, video_mb: float = 200) -> dict[str, Any]:
    """The ordered union of datasets of one version with remapped episodes, frames and tasks.

    Statistics are carried over, those of the rewritten columns (episode_index,
    index, task_index) are computed anew.
    """
    check_paths(spark, destination, sources)
    report = merge_check(spark, sources)
    if not report.ok:
        raise ValueError("; ".join(report.errors[:5]))
    parts = [open_dataset(spark, s) for s in sources]
    first = parts[0].info
    names = {full_split(p.info, p.episodes.count()) for p in parts}
    if len(names) != 1:
        raise ValueError("the sources' splits have different names")
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    tag = lambda df, i: df.withColumn("source_ordinal", F.lit(i))
    tasks = union([tag(p.tasks, i).select("source_ordinal", F.col("task_index").alias("local_index"), "task") for i, p in enumerate(parts)])
    mapped = merged_task_dictionary(tasks)
    episodes = union([tag(p.episodes, i).withColumnRenamed("episode_index", "local_episode").drop("dataset_from_index") for i, p in enumerate(parts)])
    placed = merged_episodes(episodes.select("source_ordinal", "local_episode", "length"))
    place = placed.select("source_ordinal", "local_episode", "episode_index", "dataset_from_index")
    columns = parts[0].frames.columns
    frames = union([tag(p.frames, i).withColumnRenamed("episode_index", "local_episode").withColumnRenamed("task_index", "local_index").drop("index") for i, p in enumerate(parts)])
    frames = frames.join(place, ["source_ordinal", "local_episode"]).join(mapped.drop("task"), ["source_ordinal", "local_index"], "left")
    frames = frames.withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    system = frames.groupBy("episode_index").agg(F.sort_array(F.collect_set("task_index")).alias("used"), F.min("task_index").alias("tmin"), F.max("task_index").alias("tmax"), F.avg("task_index").alias("tmean"), F.stddev_pop("task_index").alias("tstd"))
    joined = episodes.join(place, ["source_ordinal", "local_episode"]).join(system, "episode_index", "left")
    new_episodes = _restated(joined)
    total = new_episodes.count()
    info = replace(first, splits={names.pop(): f"0:{total}"}, raw={k: v for k, v in first.raw.items()})
    data = Dataset(info, frames.select(*(q(c) for c in columns)), new_episodes, mapped.select("task_index", "task").distinct())
    _publish(spark, data, destination, first.version, Output(data_mb, video_mb, overwrite, True))
    return {"destination": destination, "episodes": total, "sources": len(sources)}


def _restated(rows: DataFrame) -> DataFrame:
    """Episode rows whose statistics of rewritten columns are exact again, for the keys they had."""

    def run(batches):
        for batch in batches:
            texts = []
            for r in batch.itertuples():
                s = stats_of(r.stats_json)
                n, start = r.length, r.dataset_from_index
                exact = {"episode_index": (r.episode_index, r.episode_index, r.episode_index, 0.0), "index": (start, start + n - 1, start + (n - 1) / 2, ((n * n - 1) / 12) ** 0.5)}
                if pd.notna(getattr(r, "tmean", None)):
                    exact["task_index"] = (r.tmin, r.tmax, r.tmean, r.tstd)
                for k, (lo, hi, mean, std) in exact.items():
                    if k in s:
                        fresh = {"min": [int(lo)], "max": [int(hi)], "mean": [float(mean)], "std": [float(std)], "count": [int(n)]}
                        fresh |= {p: [float(lo + (hi - lo) * int(p[1:]) / 100)] for p in s[k] if p[:1] == "q" and p[1:].isdigit() and k != "task_index"}
                        s[k] = {key: fresh.get(key, value) for key, value in s[k].items()}
                texts.append(json.dumps(s) if s else None)
            yield pd.DataFrame({"episode_index": batch["episode_index"], "length": batch["length"], "tasks": batch["tasks"], "dataset_from_index": batch["dataset_from_index"], "stats_json": texts, "videos_json": batch["videos_json"], "extra_json": batch["extra_json"]})

    return rows.mapInPandas(run, "episode_index bigint, length bigint, tasks array<string>, dataset_from_index bigint, stats_json string, videos_json string, extra_json string")


@dataclass(frozen=True)
class EditConfig:
    """Edits that one pass applies."""

    delete_episodes: tuple[int, ...] = ()
    remove_features: tuple[str, ...] = ()
    task_by_episode: dict[int, str] = field(default_factory=dict)


def edit_dataset(spark: SparkSession, source: str, destination: str, config: EditConfig, *, overwrite: bool = False, data_mb: float = 100, video_mb: float = 200) -> dict[str, Any]:
    """Deletes episodes, drops features and relabels tasks in one plan; splits follow the survivors."""
    check_paths(spark, destination, [source])
    data = open_dataset(spark, source)
    ed.drop_features(data.frames, [n for n in config.remove_features if n not in data.info.cameras])
    named = _numbers(spark, {*config.delete_episodes, *config.task_by_episode})
    if missing := sorted(r[0] for r in named.join(data.episodes, "episode_index", "left_anti").collect()):
        raise ValueError(f"unknown episodes: {missing}")
    # asked several times: a row for each episode is kept
    survivors = ed.surviving_episodes(data.episodes.drop("dataset_from_index"), _numbers(spark, config.delete_episodes)).persist(StorageLevel.MEMORY_AND_DISK)
    left = survivors.count()
    if config.delete_episodes and left == 0:
        raise ValueError("not all episodes can be deleted")
    tasks, frames = data.tasks, data.frames
    texts = None
    if config.task_by_episode:
        overrides = spark.createDataFrame(sorted(config.task_by_episode.items()), "episode_index bigint, task string")
        tasks, override = ed.relabelled_tasks(data.tasks, overrides)
        frames, texts = ed.relabel(frames, override), overrides
    columns = [c for c in data.frames.columns if c not in config.remove_features]
    frames = ed.delete_episodes(frames, survivors).select(*(q(c) for c in columns))
    task_stats = frames.groupBy("episode_index").agg(F.min("task_index").alias("tmin"), F.max("task_index").alias("tmax"), F.avg("task_index").alias("tmean"), F.stddev_pop("task_index").alias("tstd"))
    rows = survivors
    if texts is not None:
        rows = rows.join(texts.withColumnRenamed("task", "__task"), "episode_index", "left").withColumn("tasks", F.when(F.col("__task").isNotNull(), F.array("__task")).otherwise(F.col("tasks"))).drop("__task")
    rows = rows.withColumn("episode_index", F.col("new_episode")).withColumn("dataset_from_index", F.col("new_from")).join(task_stats, "episode_index", "left")
    episodes = _restated(rows)
    if config.remove_features:
        episodes = episodes.withColumn("stats_json", _without(config.remove_features)("stats_json"))
    info = replace(data.info, features={k: f for k, f in data.info.features.items() if k not in config.remove_features}, splits=_new_splits(spark, data, survivors), raw=dict(data.info.raw))
    _publish(spark, Dataset(info, frames, episodes, tasks), destination, data.info.version, Output(data_mb, video_mb, overwrite, False))
    survivors.unpersist()
    return {"destination": destination, "episodes": left, "deleted": len(config.delete_episodes)}


def _numbers(spark: SparkSession, numbers: Iterable[int]) -> DataFrame:
    """Episode numbers as rows, however many: neither literals of a plan nor rows that a Python worker makes."""
    return spark.createDataFrame(pa.table({"episode_index": pa.array(sorted(numbers), pa.int64())}))


def _without(names: tuple[str, ...]):
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def drop(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps({k: v for k, v in stats_of(t).items() if k not in names}) if t else None)

    return drop


def _new_splits(spark: SparkSession, data: Dataset, survivors: DataFrame) -> dict[str, str]:
    if not data.info.splits:
        return {}
    ranges = spark.createDataFrame([(k, *parse_split(v)) for k, v in data.info.splits.items()], "split string, start bigint, stop bigint")
    found = {r["split"]: f"{r['start']}:{r['stop']}" for r in remap_splits(ranges, survivors.select("episode_index")).collect()}
    return {k: found[k] for k in data.info.splits}


def subset(data: Dataset, start: int, stop: int) -> Dataset:
    """Episodes start to stop - 1 as a dataset of their own; statistics stay as they were."""
    from ..operators.index import subset as cut

    episodes = data.episodes.where((F.col("episode_index") >= start) & (F.col("episode_index") < stop)).withColumn("episode_index", F.col("episode_index") - start).drop("dataset_from_index")
    placed = running_offsets(episodes, "episode_index", "length").drop("dataset_to_index")
    return data.with_(frames=cut(data.frames, start, stop), episodes=placed, info=replace(data.info, splits={"train": f"0:{stop - start}"}), root=None)


def without_videos(data: Dataset) -> Dataset:
    """The dataset without its cameras."""
    features = {k: f for k, f in data.info.features.items() if not f.is_media}
    return data.with_(info=replace(data.info, features=features), episodes=data.episodes.withColumn("videos_json", F.lit("[]")))


def repaired(data: Dataset) -> Dataset:
    """Declared shapes that differ from the values by leading ones take the values' shape; others that differ are errors.

    One frame decides for each feature: the first that has a value.
    """
    shapes = {}
    for f in data.frames.schema.fields:
        declared = data.info.features.get(f.name)
        if declared is None or not isinstance(f.dataType, T.ArrayType):
            continue
        row = data.frames.select(q(f.name).alias("v")).where("v is not null").limit(1).collect()
        if row:
            shapes[f.name] = repaired_shape(declared.shape, nested_shape(row[0]["v"]))
    features = {k: replace(f, shape=shapes.get(k, f.shape)) for k, f in data.info.features.items()}
    return data.with_(info=replace(data.info, features=features))


def from_frames(frames: DataFrame, info, *, tasks: DataFrame | None = None) -> Dataset:
    """A dataset from frames with episode_index, frame_index and ``task`` text: dictionary, offsets and statistics are computed."""
    texts = tasks or task_dictionary(frames, "task", ["episode_index", "frame_index"])
    indexed = frames.join(texts, "task")  # texts grow with the data: their size decides how they are joined
    episodes = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_set("task")).alias("tasks"))
    placed = running_offsets(episodes, "episode_index", "length").drop("dataset_to_index")
    out = indexed.join(placed.select("episode_index", "dataset_from_index"), "episode_index").withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).withColumn("timestamp", (F.col("frame_index") / F.lit(float(info.fps))).cast("float")).drop("dataset_from_index", "task")
    stats = _computed_stats(out, info)
    rows = placed.join(stats, "episode_index", "left").withColumn("videos_json", F.lit("[]")).withColumn("extra_json", F.lit(None).cast("string"))
    return Dataset(info, out, rows, texts.select("task_index", "task"))


def _computed_stats(frames: DataFrame, info) -> DataFrame:
    """(episode_index, stats_json) with the moments of every numeric feature, scalar or vector."""
    from pyspark.sql.types import ArrayType, NumericType

    long = []
    for f in frames.schema.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
            long.append(F.struct(F.lit(f.name).alias("feature"), q(f.name).cast("array<double>").alias("v")))
        elif isinstance(f.dataType, NumericType):
            long.append(F.struct(F.lit(f.name).alias("feature"), F.array(q(f.name).cast("double")).alias("v")))
    parts = frames.select("episode_index", F.explode(F.array(*long)).alias("s")).select("episode_index", "s.feature", F.posexplode("s.v").alias("pos", "x"))
    each = parts.groupBy("episode_index", "feature", "pos").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "min", "max", "mean", "std", "count")))
    lists = each.groupBy("episode_index", "feature").agg(ordered.alias("a"))
    entry = F.struct(*(_pick("a", k).alias(k) for k in ("min", "max", "mean", "std")), F.slice(_pick("a", "count"), 1, 1).alias("count"))
    return lists.groupBy("episode_index").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", entry.alias("s")))))).alias("stats_json"))


def _pick(array: str, key: str):
    return F.transform(array, lambda x: x[key])
