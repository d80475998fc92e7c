"""Recordings of files named by their time: JSON joints and JPEG cameras.

A folder for each episode holds ``camera/color/<name>/<seconds>.jpg`` and
``arm/jointState/<role>/<seconds>.json`` with seven positions.  The cameras'
newest common frames set the clock (the first camera's times); each joint
stream gives its last sample at or before a frame, or else its first one.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import all_finite, natural_key, numeric_stem
from ..model import Dataset, Info
from ..operators.align import asof_clamped
from ..plans.datasets import from_frames
from ..schema import SYSTEM_FEATURES, Feature
from .registry import SourceProvider

JOINTS = 7
CAMERA = "observation.images."


@dataclass(frozen=True)
class TimestampedConfig:
    """The instruction of all episodes, the rate, and which arms make state and action."""

    instruction: str = "unnamed task"
    fps: int = 30
    robot_type: str | None = "agilex"
    cameras: tuple[str, ...] = ("left", "front", "right")
    state: tuple[str, str] = ("puppetLeft", "puppetRight")
    action: tuple[str, str] = ("masterLeft", "masterRight")
    #: Whether the cameras become features, with a video of each episode where the dataset is written.
    videos: bool = True


def _listed(spark: SparkSession, root: str, pattern: str, payload: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("stream"), F.element_at(parts, -5).alias("folder"), numeric_stem("path").alias("t"), *([F.col("content")] if payload else []))
    return out.where("t is not null")


def read_timestamped(spark: SparkSession, root: str, config: TimestampedConfig | None = None) -> Dataset:
    config = config or TimestampedConfig()
    # names of images are read, never their bytes
    images = _listed(spark, root, "*.jpg", False).where(F.col("stream").isin(*config.cameras))
    joints = _listed(spark, root, "*.json", True).where(F.col("stream").isin(*config.state, *config.action))
    joints = joints.select("folder", "stream", "t", F.from_json(F.col("content").cast("string"), "position array<double>")["position"].alias("position"))
    bad = joints.where(~F.coalesce(all_finite(F.col("position"), JOINTS), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['folder']}/{bad[0]['stream']} at {bad[0]['t']}: not {JOINTS} finite positions")
    folders = images.select("folder").distinct().withColumn("key", natural_key(F.col("folder")))
    # natural order over one row for each episode
    ranked = folders.select("folder", (F.row_number().over(Window.orderBy("key", "folder")) - 1).cast("bigint").alias("episode_index"))
    newest = Window.partitionBy("folder", "stream").orderBy(F.desc("t"))
    numbered = images.withColumn("rank", F.row_number().over(newest))
    paired = numbered.groupBy("folder", "rank").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("stream") == config.cameras[0], F.col("t"))).alias("t")).where(F.col("n") == len(config.cameras))
    anchors = paired.select("folder", "t")
    for side in (*config.state, *config.action):
        samples = joints.where(F.col("stream") == side).select("folder", "t", F.col("position").alias(side))
        anchors = asof_clamped(anchors, samples, by=["folder"], on="t", value=side, tie=[])
    within = Window.partitionBy("episode_index").orderBy("t")
    both = anchors.join(ranked, "folder").withColumn("frame_index", (F.row_number().over(within) - 1).cast("bigint"))
    vector = lambda pair: F.concat(*(F.col(p) for p in pair)).cast("array<float>")
    frames = both.select("episode_index", "frame_index", F.lit(config.instruction).alias("task"), vector(config.state).alias("observation.state"), vector(config.action).alias("action"))
    features = {"observation.state": Feature("float32", (2 * JOINTS,)), "action": Feature("float32", (2 * JOINTS,))} | {k: Feature(d) for k, d in SYSTEM_FEATURES.items()}
    total = ranked.count()
    if not total:
        raise FileNotFoundError(f"no episodes below {root}")
    if not config.videos:
        return from_frames(frames, Info("v3.0", config.fps, features, config.robot_type, {"train": f"0:{total}"}))
    # the pictures that the clock counts, in the order of the frames
    last = numbered.join(paired.select("folder", "rank"), ["folder", "rank"]).join(ranked, "folder")
    count = F.max("rank").over(Window.partitionBy("folder"))
    pictures = last.select("episode_index", F.concat(F.lit(CAMERA), "stream").alias("camera"), (count - F.col("rank")).cast("bigint").alias("frame_index"), "path", F.lit(None).cast("string").alias("key"))
    features |= {CAMERA + k: Feature("video", (1, 1, 3)) for k in config.cameras}
    return from_frames(frames, Info("v3.0", config.fps, features, config.robot_type, {"train": f"0:{total}"})).with_(pictures=pictures)


def image_index(spark: SparkSession, root: str, config: TimestampedConfig | None = None) -> DataFrame:
    """(folder, stream, t, path) of every image, for media jobs; bytes are read where they are used."""
    config = config or TimestampedConfig()
    return _listed(spark, root, "*.jpg", False).where(F.col("stream").isin(*config.cameras))


class TimestampedProvider(SourceProvider):
    """Recordings of files named by their time."""

    name = "agilex"
    config_type = TimestampedConfig

    def config_from_dict(self, raw: dict[str, Any]) -> TimestampedConfig:
        return super().config_from_dict({k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def open(self, spark: SparkSession, root: str, config: Any = None) -> Dataset:
        return read_timestamped(spark, root, config)


__all__ = ["TimestampedConfig", "TimestampedProvider", "image_index", "read_timestamped"]
