"""A dataset as DataFrames: frames, episodes and tasks, with driver-side metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Feature, video_keys

# fixed values of both layouts: where data and videos lie
V21_DATA = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
V21_VIDEO = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
V30_DATA = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
V30_VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"

STATS_KEYS = ("min", "max", "mean", "std", "count")


@dataclass(frozen=True)
class Info:
    """Metadata of a dataset."""

    version: str
    fps: int
    features: dict[str, Feature]
    robot_type: str | None = None
    splits: dict[str, str] = field(default_factory=dict)
    chunks_size: int = 1000
    data_path: str | None = None
    video_path: str | None = None
    raw: dict[str, Any] = field(default_factory=dict)

    @property
    def cameras(self) -> list[str]:
        return video_keys(self.features)


@dataclass(frozen=True)
class Dataset:
    """``frames`` by (episode_index, frame_index); ``episodes`` (episode_index, length, tasks,
    dataset_from_index, stats_json, videos_json, extra_json); ``tasks`` (task_index, task).

    videos_json lists the episode's slices (VIDEO_SLICES).  A slice names its
    file by a whole path, so an episode keeps its videos whatever number it gets
    and whichever dataset it goes to.  ``root`` is where the dataset lies as it
    is; one that was changed lies nowhere yet.
    """

    info: Info
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    root: str | None = None
    #: Pictures that are no video yet: (episode_index, camera, frame_index, path, key), where key names an array within the file or is null.
    pictures: DataFrame | None = None

    def with_(self, **changes: Any) -> Dataset:
        return replace(self, **changes)

    def episodes_of(self, numbers: list[int]) -> DataFrame:
        """The frames of several episodes in one scan; few numbers reach it as a filter, many as a join."""
        if len(numbers) <= 1000:
            return self.frames.where(self.frames["episode_index"].isin(numbers))
        wanted = self.frames.sparkSession.createDataFrame([(n,) for n in set(numbers)], "episode_index bigint")
        return self.frames.join(wanted, "episode_index", "left_semi")

    def episode(self, number: int) -> DataFrame:
        """The frames of one episode; the filter reaches the Parquet scan."""
        return self.frames.where(self.frames["episode_index"] == number)


VIDEO_SLICES = "array<struct<camera:string,path:string,from_timestamp:double,to_timestamp:double>>"


def video_slice(camera: str, path: Column, start: Column, stop: Column) -> Column:
    return F.struct(F.lit(camera).alias("camera"), path.alias("path"), start.cast("double").alias("from_timestamp"), stop.cast("double").alias("to_timestamp"))


EPISODE_SCHEMA = "episode_index bigint, length bigint, tasks array<string>, dataset_from_index bigint, stats_json string, videos_json string, extra_json string"


def parse_split(text: str) -> tuple[int, int]:
    a, colon, b = text.partition(":")
    if not colon or not a.strip().isdigit() or not b.strip().isdigit():
        raise ValueError(f"not a half-open range: {text!r}")
    return int(a), int(b)


def full_split(info: Info, episodes: int) -> str:
    """The name of the one split that covers all episodes; anything else is an error."""
    if len(info.splits) != 1:
        raise ValueError("a merge needs exactly one split in each source")
    name, text = next(iter(info.splits.items()))
    if parse_split(text) != (0, episodes):
        raise ValueError(f"split {name!r} does not cover all episodes")
    return name


def normalize_version(version: str) -> str:
    """v2.1 or v3.0 from the ways to write them."""
    v = str(version).strip().lower()
    for prefix in ("lerobot-", "lerobot_", "v"):
        v = v.removeprefix(prefix)
    v = v.removeprefix("v")
    if v in ("2.1", "21"):
        return "v2.1"
    if v in ("3", "30", "3.0"):
        return "v3.0"
    raise ValueError(f"unknown dataset version: {version!r}")
