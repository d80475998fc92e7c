"""Media work as rows of jobs: each job is one output file, made by one task from packets.

A slice is a stretch of a file that shows one episode by one camera.  Slices
name their files by whole paths (model.Dataset), so a subset, an edit or a
merge takes the packets of the episodes that it keeps, whatever their numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import replace
from typing import BinaryIO

import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import formatted
from ..model import V21_VIDEO, V30_VIDEO, VIDEO_SLICES, Dataset, video_slice
from ..operators.index import location
from ..operators.pack import greedy_pack_within
from ..schema import Feature
from ..sources import stores
from . import mp4

#: MiB of a packed video file.
VIDEO_MB = 200


class _Files:
    """The file read last, open, with its sample table: slices of one file come one after the other."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.file: BinaryIO | None = None
        self.track: mp4.Track | None = None

    def get(self, path: str) -> tuple[BinaryIO, mp4.Track]:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.file = stores.reader(path)
            self.path, self.track = path, mp4.read_track(self.file)
        return self.file, self.track

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = self.track = None


def _tasks(df: DataFrame) -> int:
    # rows are tiny beside the files they name, so their size must not decide how many tasks share them
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def slice_paths(data: Dataset) -> DataFrame:
    """(episode_index, length, camera, path, start, stop) of every episode's slice of every camera."""
    rows = data.episodes.select("episode_index", "length", F.explode(F.from_json("videos_json", VIDEO_SLICES)).alias("v"))
    flat = rows.select("episode_index", "length", F.col("v.camera").alias("camera"), F.col("v.path").alias("path"), F.col("v.from_timestamp").alias("start"), F.col("v.to_timestamp").alias("stop"))
    return flat.where(F.col("camera").isin(data.info.cameras))


def measured_slices(slices: DataFrame) -> DataFrame:
    """Adds packets, bytes, ticks (at the stream's timescale) and seconds of each slice, packets of its file, whether it begins with a key frame, and the stream that it can be joined with.

    Sample tables are read, packets are not.
    """
    columns, more = slices.columns, ["packets", "bytes", "ticks", "timescale", "seconds", "file_packets", "safe", "stream"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files()
        for batch in batches:
            found = []
            for job in batch.itertuples():
                _, track = files.get(job.path)
                chosen = mp4.within(track, job.start, job.stop)
                stream = hashlib.sha256(track.description + str(track.timescale).encode()).hexdigest()
                ticks = sum(s.duration for s in chosen)
                found.append((len(chosen), sum(s.size for s in chosen), ticks, track.timescale, ticks / track.timescale, len(track.samples), bool(chosen) and chosen[0].key, stream))
            yield pd.concat([batch, pd.DataFrame(found, columns=more, index=batch.index)], axis=1)[[*columns, *more]]

    placed = slices.repartition(_tasks(slices), "path").sortWithinPartitions("path", "start")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slices.schema.fields)
    return placed.mapInPandas(run, schema + ", packets bigint, bytes bigint, ticks bigint, timescale bigint, seconds double, file_packets bigint, safe boolean, stream string")


def planned(data: Dataset, version: str, *, video_mb: float = VIDEO_MB, slices: DataFrame | None = None) -> DataFrame:
    """Slices with their place in the target layout: target, file, mode, from_timestamp, to_timestamp.

    v2.1 has a file for each episode and camera.  v3.0 packs a camera's episodes
    in order up to ``video_mb`` MiB and opens a new file where streams cannot be
    joined; a source that is packed already keeps its files, so one that keeps
    all its slices is copied as it is.  ``mode`` is reuse, remux or transcode.
    ``slices`` are the measured slices, where the caller keeps them.
    """
    slices = measured_slices(slice_paths(data)) if slices is None else slices
    size = data.info.chunks_size
    if version == "v2.1":
        own = slices.withColumn("file", F.col("episode_index"))
        target = lambda k, chunk, file: formatted(V21_VIDEO, video_key=k, episode_chunk=chunk, episode_index=F.col("file"))
    else:
        if data.info.version == "v3.0":
            order = Window.partitionBy("camera").orderBy("first", "path")
            files = slices.groupBy("camera", "path", "stream").agg(F.min("episode_index").alias("first")).withColumn("file", (F.row_number().over(order) - 1).cast("bigint"))
            own = slices.join(files.select("camera", "path", "file"), ["camera", "path"])
        else:
            own = greedy_pack_within(slices, by="camera", key="episode_index", size="bytes", limit=int(video_mb * (1 << 20)), breaks="stream")
        target = lambda k, chunk, file: formatted(V30_VIDEO, video_key=k, chunk_index=chunk, file_index=file)
    chunk, file = location(F.col("file"), size)
    name = F.lit(None).cast("string")
    for k in data.info.cameras:
        name = F.when(F.col("camera") == k, target(k, chunk, file)).otherwise(name)
    named = own.withColumn("target", name)
    upto = Window.partitionBy("target").orderBy("episode_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a file has one timescale, and ticks are whole: a sum of seconds drifts over many slices
    stop = F.sum("ticks").over(upto)
    timed = named.withColumn("to_timestamp", stop / F.col("timescale")).withColumn("from_timestamp", (stop - F.col("ticks")) / F.col("timescale"))
    whole = timed.groupBy("target").agg(F.count_distinct("path").alias("paths"), F.sum("packets").alias("kept"), F.max("file_packets").alias("there"), F.min(F.col("safe").cast("int")).alias("safe"))
    # one source and all of its packets: the file is reused as it is; else its slices are cut out, where that needs no codec
    mode = F.when((F.col("paths") == 1) & (F.col("kept") == F.col("there")), "reuse").when(F.col("safe") == 1, "remux").otherwise("transcode")
    return timed.drop("safe").join(whole.select("target", mode.alias("mode")), "target")


def copy_media(data: Dataset, root: str, version: str, *, video_mb: float = VIDEO_MB) -> Dataset:
    """Writes every slice to its place in the target layout and points the episodes there.

    Jobs with the most bytes come first.  A task streams packets from its sources
    to its file, checks their number, and names the file when it is whole.
    """
    if not data.info.cameras:
        return data
    # the sources' sample tables are read once: a row for each slice is kept
    slices = measured_slices(slice_paths(data)).persist(StorageLevel.MEMORY_AND_DISK)
    jobs = planned(data, version, video_mb=video_mb, slices=slices).persist(StorageLevel.MEMORY_AND_DISK)
    spark = data.frames.sparkSession
    base = files_root(spark, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        held: list = []
        for batch in batches:
            done = []
            for job in batch.itertuples():
                if held and held[0].target != job.target:
                    done.append(_write(held, base, attempt))
                    held = []
                held.append(job)
            yield pd.DataFrame(done, columns=["target", "bytes", "packets"])
        if held:
            yield pd.DataFrame([_write(held, base, attempt)], columns=["target", "bytes", "packets"])

    heavy = Window.partitionBy("target")
    placed = jobs.withColumn("cost", F.sum("bytes").over(heavy)).repartition(_tasks(jobs), "target").sortWithinPartitions(F.desc("cost"), "target", "episode_index")
    placed.select("target", "path", "start", "stop", "mode", "packets", "bytes", "episode_index").mapInPandas(run, "target string, bytes bigint, packets bigint").agg(F.sum("bytes")).first()
    slices.unpersist()
    there = F.concat(F.lit(base + "/"), F.col("target"))
    entries = None
    for k in data.info.cameras:
        entry = F.when(F.col("camera") == k, video_slice(k, there, F.col("from_timestamp"), F.col("to_timestamp")))
        entries = entry if entries is None else F.coalesce(entries, entry)
    listed = jobs.groupBy("episode_index").agg(F.to_json(F.sort_array(F.collect_list(entries))).alias("videos_json"))
    return data.with_(episodes=data.episodes.drop("videos_json").join(listed, "episode_index", "left").withColumn("videos_json", F.coalesce("videos_json", F.lit("[]"))))


def files_root(spark: SparkSession, root: str) -> str:
    from ..sources.files import qualified

    return qualified(spark, root)


def _write(slices: list, base: str, attempt: int) -> tuple[str, int, int]:
    """One output file from its slices; (target, bytes, packets)."""
    target, expected = slices[0].target, sum(s.packets for s in slices)
    if slices[0].mode == "transcode":
        raise ValueError(f"{target}: a slice does not begin with a key frame, and to cut there needs a codec")
    files, made = _Files(), []

    def opened() -> Iterator[tuple[BinaryIO, mp4.Track, float, float]]:
        for s in slices:
            yield *files.get(s.path), s.start, s.stop

    def fill(out: BinaryIO) -> None:
        if slices[0].mode == "reuse":
            file, track = files.get(slices[0].path)
            stores.copy(file, out)
            made.append(len(track.samples))
        else:  # a packed file may have more sources than a task can hold open
            made.append(len(mp4.join_slices(opened(), out, sum(s.bytes for s in slices)).samples))

    try:
        written = stores.write(f"{base}/{target}", attempt, fill)
    finally:
        files.close()
    if made != [expected]:
        raise ValueError(f"{target}: {made[0]} packets written, {expected} expected")
    return target, written, expected


def picture_batches(path: str, key: str | None, start: int, stop: int, size: int = 256) -> Iterator[list[bytes]]:
    """Encoded pictures start to stop - 1 of an array within a file, through one handle; without a key the file is the picture."""
    if key is None:
        with stores.reader(path) as file:
            yield [file.read()]
        return
    import h5py
    import numpy as np

    with stores.reader(path) as raw, h5py.File(raw, "r") as file:
        for at in range(start, stop, size):
            yield [np.asarray(x, np.uint8).tobytes().rstrip(b"\0") if not isinstance(x, bytes) else x for x in file[key][at : min(stop, at + size)]]


def mux_pictures(data: Dataset, folder: str) -> Dataset:
    """Makes a video of each episode's pictures by each camera below ``folder`` and notes the streams' settings."""
    spark, fps = data.frames.sparkSession, data.info.fps
    base = files_root(spark, folder)

    def made(held: list, attempt: int) -> tuple[int, str, str, int]:
        episode, camera = held[0].episode_index, held[0].camera
        target = f"{base}/{camera}/episode_{episode:06d}.mp4"

        def frames() -> Iterator[bytes]:
            at = 0
            while at < len(held):  # pictures that lie together in one array are read together
                end = at + 1
                while end < len(held) and held[at].key is not None and (held[end].path, held[end].key) == (held[at].path, held[at].key):
                    end += 1
                for batch in picture_batches(held[at].path, held[at].key, held[at].frame_index, held[end - 1].frame_index + 1):
                    yield from batch
                at = end

        sizes = [len(f) for f in frames()]
        stores.write(target, attempt, lambda out: mp4.mux_jpegs(frames(), fps, out, sizes))
        return episode, camera, target, len(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, held, names = TaskContext.get().taskAttemptId(), [], ["episode_index", "camera", "path", "n"]
        for batch in batches:
            done = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples():
                if held and (held[0].episode_index, held[0].camera) != (row.episode_index, row.camera):
                    done.append(made(held, attempt))
                    held = []
                held.append(row)
            yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame([made(held, attempt)], columns=names)

    rows = data.pictures.select("episode_index", "camera", "frame_index", "path", "key")
    placed = rows.repartition(_tasks(rows), "episode_index", "camera").sortWithinPartitions("episode_index", "camera", "frame_index")
    done = placed.mapInPandas(run, "episode_index bigint, camera string, path string, n bigint").persist(StorageLevel.MEMORY_AND_DISK)
    one = {r["camera"]: r["path"] for r in done.groupBy("camera").agg(F.min("path").alias("path")).collect()}
    features = dict(data.info.features)
    for camera, path in one.items():
        with stores.reader(path) as file:
            features[camera] = _with_settings(features[camera], mp4.probe(file))
    entry = F.struct("camera", "path", F.lit(0.0).alias("from_timestamp"), (F.col("n") / F.lit(float(fps))).alias("to_timestamp"))
    listed = done.groupBy("episode_index").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("videos_json"))
    episodes = data.episodes.drop("videos_json").join(listed, "episode_index", "left").withColumn("videos_json", F.coalesce("videos_json", F.lit("[]")))
    return data.with_(info=replace(data.info, features=features), episodes=episodes, pictures=None)


def _with_settings(feature: Feature, probe: dict) -> Feature:
    """A camera's feature with the settings of its real stream."""
    told = {"video.codec": probe["codec"], "video.height": probe["height"], "video.width": probe["width"], "video.fps": probe["fps"], "has_audio": probe["audio"]}
    return replace(feature, shape=(probe["height"], probe["width"], 3), extra=feature.extra | {"info": told})


def video_digests(data: Dataset) -> DataFrame:
    """(episode_index, camera, digest) over the packets of every slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files()
        for batch in batches:
            digests = []
            for job in batch.itertuples():
                file, track = files.get(job.path)
                digests.append(mp4.packet_digest(file, job.start, job.stop, track))
            yield pd.DataFrame({"episode_index": batch["episode_index"], "camera": batch["camera"], "digest": digests})

    slices = slice_paths(data)
    return slices.repartition(_tasks(slices), "path").sortWithinPartitions("path", "start").mapInPandas(run, "episode_index bigint, camera string, digest string")


def video_faults(data: Dataset, *, deep: bool = False) -> DataFrame:
    """(episode_index, code, message): missing references and files, and with ``deep`` files shorter than their slices need."""
    slices = slice_paths(data)
    wanted = data.episodes.select("episode_index", F.explode(F.array(*map(F.lit, data.info.cameras))).alias("camera")) if data.info.cameras else data.episodes.select("episode_index").limit(0).withColumn("camera", F.lit(""))
    without = wanted.join(slices.select("episode_index", "camera"), ["episode_index", "camera"], "left_anti")
    none = without.select("episode_index", F.lit("video_reference").alias("code"), F.format_string("no %s video", "camera").alias("message"))
    fps = float(data.info.fps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job in batch.itertuples():
                if not stores.exists(job.path):
                    out.append((job.episode_index, "missing_video", f"missing video file {job.path}"))
                elif deep:
                    with stores.reader(job.path) as file:
                        try:
                            seconds = mp4.read_track(file).duration
                        except ValueError as e:
                            out.append((job.episode_index, "unreadable_video", f"{job.path}: {e}"))
                            continue
                    if seconds + 1 / fps < job.needed:
                        out.append((job.episode_index, "short_video", f"{job.path}: {seconds:.6f} s are there, {job.needed:.6f} s are needed"))
            yield pd.DataFrame(out, columns=["episode_index", "code", "message"])

    files = slices.groupBy("path").agg(F.min("episode_index").alias("episode_index"), F.max("stop").alias("needed"))
    found = files.repartition(_tasks(files), "path").mapInPandas(run, "episode_index bigint, code string, message string")
    return none.unionByName(found)


def probe_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, report as JSON) of every MP4 file below a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reports = []
            for path in batch["path"]:
                with stores.reader(path) as file:
                    reports.append(json.dumps(mp4.probe(file)))
            yield pd.DataFrame({"path": batch["path"], "report": reports})

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(root).select("path")
    return listed.mapInPandas(run, "path string, report string")
