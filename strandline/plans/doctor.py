"""A report on a dataset's quality, and repairs.

The checks are those of operators.quality over every numeric feature; limits
are this library's own and are fields of ``Limits``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import q
from ..model import Dataset
from ..operators import quality
from ..operators.index import running_offsets
from ..schema import SYSTEM_FEATURES
from ..sources import files
from ..sources.layouts import open_dataset
from .datasets import Report, validate


@dataclass(frozen=True)
class Limits:
    short: int = 10
    #: Share of a frame by which two timestamps may miss the rate.
    timing: float = 0.5
    #: A step between frames larger than so many standard deviations of the feature is a jump.
    jump_sigmas: float = 10.0
    drop_score: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: {"short": 0.3, "timing": 0.2, "non_finite": 0.3, "frozen": 0.1, "jumps": 0.1, "duplicate": 0.2})


def _components(data: Dataset) -> DataFrame:
    """(episode_index, frame_index, feature, component, x) of every numeric feature that is not generated."""
    parts = []
    for f in data.frames.schema.fields:
        if f.name in SYSTEM_FEATURES:
            continue
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            parts.append(F.struct(F.lit(f.name).alias("feature"), q(f.name).cast("array<double>").alias("v")))
        elif isinstance(f.dataType, T.NumericType):
            parts.append(F.struct(F.lit(f.name).alias("feature"), F.array(q(f.name).cast("double")).alias("v")))
    if not parts:
        return data.frames.select("episode_index", "frame_index", F.lit("").alias("feature"), F.lit(0).alias("component"), F.lit(0.0).alias("x")).limit(0)
    exploded = data.frames.select("episode_index", "frame_index", F.explode(F.array(*parts)).alias("s"))
    return exploded.select("episode_index", "frame_index", "s.feature", F.posexplode("s.v").alias("component", "x"))


def episode_reasons(data: Dataset, limits: Limits | None = None) -> DataFrame:
    """(episode_index, reasons): what speaks against each episode, an empty array for none."""
    limits = limits or Limits()
    parts = _components(data)
    key = ["episode_index", "feature", "component"]
    order = Window.partitionBy(*key).orderBy("frame_index")
    good = ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    spread = parts.where(good).groupBy("feature", "component").agg(F.stddev_pop("x").alias("sd"))
    stepped = parts.withColumn("step", F.abs(F.col("x") - F.lag("x").over(order))).join(F.broadcast(spread), ["feature", "component"], "left")
    told = stepped.groupBy(*key).agg(F.max((~F.coalesce(good, F.lit(False))).cast("int")).alias("bad"), F.coalesce(F.stddev_pop("x") == 0, F.lit(False)).cast("int").alias("frozen"), F.max(F.coalesce(F.col("step") > limits.jump_sigmas * F.col("sd"), F.lit(False)).cast("int")).alias("jump"))
    values = told.groupBy("episode_index").agg(F.max("bad").alias("bad"), F.min("frozen").alias("frozen"), F.max("jump").alias("jump"))
    fps = data.info.fps
    late = quality.temporal_gaps(data.frames, by=["episode_index"], order=["frame_index"], seconds=F.col("timestamp").cast("double"), fps=fps, tolerance=limits.timing) if "timestamp" in data.frames.columns else None
    out = data.episodes.select("episode_index", "length").join(values, "episode_index", "left")
    out = out.join(late.select("episode_index").distinct().withColumn("late", F.lit(1)), "episode_index", "left") if late is not None else out.withColumn("late", F.lit(0))
    out = out.join(duplicate_episodes(data).withColumn("duplicate", F.lit(1)), "episode_index", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    reasons = F.array_compact(F.array(F.when(F.col("length") < limits.short, "short"), F.when(yes("late"), "timing"), F.when(yes("bad"), "non_finite"), F.when(yes("frozen"), "frozen"), F.when(yes("jump"), "jumps"), F.when(yes("duplicate"), "duplicate")))
    return out.select("episode_index", reasons.alias("reasons"))


def duplicate_episodes(data: Dataset) -> DataFrame:
    """Episodes whose values equal those of an earlier episode, frame by frame.

    A frame is a hash of its values and its number; an episode is the sum of
    its frames' hashes and their count, so no episode is gathered in one place.
    """
    columns = [q(c) for c in data.frames.columns if c not in SYSTEM_FEATURES]
    if not columns:
        return data.episodes.select("episode_index").limit(0)
    hashed = data.frames.select("episode_index", F.xxhash64("frame_index", *columns).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(7), "frame_index", *columns).cast("decimal(38,0)").alias("g"))
    episodes = hashed.groupBy("episode_index").agg(F.sum("h").alias("h"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    firsts = episodes.groupBy("h", "g", "n").agg(F.min("episode_index").alias("first"))
    return episodes.join(firsts, ["h", "g", "n"]).where("episode_index > first").select("episode_index")


def scores(data: Dataset, limits: Limits | None = None) -> DataFrame:
    """(episode_index, score, keep, reasons): 1 less the weight of each reason, and whether that passes."""
    limits = limits or Limits()
    rated = episode_reasons(data, limits)
    lost = reduce(lambda a, b: a + b, (F.when(F.array_contains("reasons", r), w).otherwise(0.0) for r, w in limits.weights.items()))
    score = F.greatest(F.lit(0.0), 1 - lost)
    return rated.select("episode_index", score.alias("score"), (score >= limits.drop_score).alias("keep"), "reasons")


#: For each policy: frames of its action window, and whether it needs a camera. Ours, and parameters of ``gate``.
POLICIES: dict[str, tuple[int, bool]] = {"act": (100, True), "diffusion": (16, True), "smolvla": (50, True), "pi0": (50, True)}


def gate(data: Dataset, policy: str, *, chunk_size: int | None = None, state: str = "observation.state", action: str = "action") -> Report:
    """Whether a policy can be trained: features and cameras there, statistics usable, episodes as long as its window."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known are {', '.join(sorted(POLICIES))}")
    window, needs_camera = POLICIES[policy]
    window = chunk_size or window
    errors, warnings = [], []
    errors += [f"there is no feature {k}" for k in (state, action) if k not in data.info.features]
    if needs_camera and not data.info.cameras:
        errors.append("there is no camera")
    whole = data.episodes.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("length") < window).cast("int")).alias("short"), F.sum(F.col("stats_json").isNull().cast("int")).alias("bare")).first()
    if whole["n"] and whole["short"] == whole["n"]:
        errors.append(f"no episode has {window} frames")
    elif whole["short"]:
        warnings.append(f"{whole['short']} of {whole['n']} episodes have fewer than {window} frames")
    if whole["bare"]:
        errors.append(f"{whole['bare']} episodes have no statistics to normalise by")
    return Report(errors, warnings)


def portability(spark: SparkSession, root: str, *, large: int = 5 << 30) -> Report:
    """What hinders moving a dataset: links, whole paths in its metadata, very large files, and files that the layout does not know."""
    errors = [f"a link: {p}" for p in files.links(spark, root)]
    raw = files.read_json(spark, f"{root}/meta/info.json")
    errors += [f"{k} is a whole path: {raw[k]}" for k in ("data_path", "video_path") if str(raw.get(k) or "").startswith(("/", "file:")) or "://" in str(raw.get(k) or "")]
    there = files.listing(spark, root)
    warnings = [f"{name} has {size} bytes" for name, size in there if size > large]
    warnings += [f"{name} is no file of the layout" for name, _ in there if not name.startswith(("data/", "meta/", "videos/")) and name not in ("README.md", ".gitattributes")][:50]
    return Report(errors, warnings)


def doctor(spark: SparkSession, root: str, limits: Limits | None = None) -> dict[str, Any]:
    """Validation, findings by kind with how many episodes each has, and whether training may start."""
    report: Report = validate(spark, root, deep=True)
    if not report.ok:
        return {"ok": False, "errors": report.errors, "findings": {}, "ready": False}
    data = open_dataset(spark, root)
    rated = scores(data, limits)
    found = {r["reason"]: r["n"] for r in rated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = rated.agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("keep")).cast("int")).alias("bad"), F.avg("score").alias("score")).first()
    vectors = [f.name for f in data.frames.schema.fields if isinstance(f.dataType, T.ArrayType)]
    sizes = quality.consistency(data.frames, vectors).first().asDict() if vectors else {}
    ragged = sorted(k for k, n in sizes.items() if n > 1)
    videos = portability(spark, root)
    return {"ok": True, "errors": [], "findings": dict(sorted(found.items())), "ragged": ragged, "episodes": whole["n"], "below": whole["bad"] or 0, "score": whole["score"], "warnings": [*report.warnings, *videos.errors, *videos.warnings], "ready": not ragged and not whole["bad"]}


def fixed(data: Dataset, *, timestamps: bool = True, values: tuple[str, ...] = ()) -> Dataset:
    """Frames renumbered from 0 in each episode with the rate's timestamps, and broken scalars filled."""
    frames = data.frames
    for v in values:
        frames = quality.fix_nan(frames, by=["episode_index"], order=["frame_index"], value=v)
    if timestamps:
        frames = quality.fix_timestamps(frames, by=["episode_index"], order=["frame_index"], fps=data.info.fps)
    length = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    episodes = running_offsets(data.episodes.drop("length", "dataset_from_index").join(length, "episode_index"), "episode_index", "length").drop("dataset_to_index")
    placed = frames.drop("index").join(episodes.select("episode_index", "dataset_from_index"), "episode_index").withColumn("index", F.col("dataset_from_index") + F.col("frame_index"))
    return data.with_(frames=placed.select(*(q(c) for c in data.frames.columns)), episodes=episodes.select(*data.episodes.columns))
