"""Hierarchical-array recordings: one file for each episode, fields by a declared mapping.

Needs ``h5py`` on the executors; without it opening says so.  Each file is read
by one task in row batches, so the driver never holds values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Dataset, Info
from ..plans.datasets import from_frames
from ..schema import LEAVES, SYSTEM_FEATURES, Feature
from . import files, stores
from .registry import SourceProvider


@dataclass(frozen=True)
class NumericField:
    """One array of the file and the feature that it becomes."""

    key: str
    target: str
    dtype: str = "float32"
    width: int = 1


@dataclass(frozen=True)
class VideoField:
    """An array of encoded pictures and the camera that it becomes."""

    key: str
    target: str


@dataclass(frozen=True)
class Hdf5Config:
    fields: tuple[NumericField, ...] = ()
    videos: tuple[VideoField, ...] = ()
    fps: int = 30
    task_key: str | None = "language_instruction"
    default_task: str = "unnamed task"
    robot_type: str | None = None
    pattern: str = ".hdf5"

    def checked(self) -> Hdf5Config:
        """Itself, if its targets are distinct, not reserved and of known types."""
        if not self.fields:
            raise ValueError("a mapping needs a field")
        targets = [f.target for f in (*self.fields, *self.videos)]
        if self.fps <= 0:
            raise ValueError("the rate must be positive")
        if any(f.width < 1 for f in self.fields):
            raise ValueError("a width must be positive")
        if len(set(targets)) != len(targets):
            raise ValueError("two fields have the same target")
        if reserved := sorted(set(targets) & set(SYSTEM_FEATURES)):
            raise ValueError(f"reserved targets: {', '.join(reserved)}")
        if unknown := sorted({f.dtype for f in self.fields} - set(LEAVES)):
            raise ValueError(f"unknown types: {', '.join(unknown)}")
        return self


def read_hdf5(spark: SparkSession, root: str, config: Hdf5Config) -> Dataset:
    config = config.checked()
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the package h5py") from e
    names = sorted((n for n, _ in files.listing(spark, root) if n.endswith(config.pattern)), key=files.natural_sort_key)
    if not names:
        raise FileNotFoundError(f"no {config.pattern} files below {root}")
    base = files.qualified(spark, root)
    columns = ", ".join(f"`{f.target}` array<double>" for f in config.fields)
    schema = f"episode_index bigint, frame_index bigint, task string, {columns}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py
        import numpy as np

        for batch in batches:
            for episode, name in zip(batch["episode"], batch["name"], strict=True):
                with stores.reader(f"{base}/{name}") as raw, h5py.File(raw, "r") as file:
                    task = config.default_task
                    if config.task_key and config.task_key in file:
                        text = file[config.task_key][()]
                        task = text.decode() if isinstance(text, bytes) else str(text)
                    n = min(len(file[f.key]) for f in config.fields)
                    for at in range(0, n, 4096):
                        stop = min(n, at + 4096)
                        out = {"episode_index": episode, "frame_index": np.arange(at, stop), "task": task}
                        for f in config.fields:
                            part = np.asarray(file[f.key][at:stop], float).reshape(stop - at, -1)
                            out[f.target] = list(part)
                        yield pd.DataFrame(out)

    listed = spark.createDataFrame(list(enumerate(names)), "episode bigint, name string").repartition(len(names))
    frames = listed.mapInPandas(read, schema)
    for f in config.fields:
        frames = frames.withColumn(f.target, frames[f"`{f.target}`"].cast(f"array<{LEAVES[f.dtype].simpleString()}>"))
    features = {f.target: Feature(f.dtype, (f.width,)) for f in config.fields} | {k: Feature(d) for k, d in SYSTEM_FEATURES.items()}
    features |= {v.target: Feature("video", (1, 1, 3)) for v in config.videos}
    data = from_frames(frames, Info("v3.0", config.fps, features, config.robot_type, {"train": f"0:{len(names)}"}))
    if not config.videos:
        return data
    cameras = spark.createDataFrame([(v.target, v.key) for v in config.videos], "camera string, key string")
    paths = spark.createDataFrame([(i, f"{files.qualified(spark, root)}/{n}") for i, n in enumerate(names)], "episode_index bigint, path string")
    rows = data.frames.select("episode_index", "frame_index").join(paths, "episode_index").join(F.broadcast(cameras), F.lit(True))
    return data.with_(pictures=rows.select("episode_index", "camera", "frame_index", "path", "key"))


def inventory(path: str) -> list[dict[str, Any]]:
    """What a file holds: key, shape, type and kind (encoded_image, numeric, text or unsupported) of each array."""
    import h5py

    found: list[dict[str, Any]] = []

    def visit(key: str, item: Any) -> None:
        if not isinstance(item, h5py.Dataset):
            return
        kind = "unsupported"
        if h5py.check_string_dtype(item.dtype) is not None:
            kind = "text"
        elif h5py.check_vlen_dtype(item.dtype) is not None and h5py.check_vlen_dtype(item.dtype).kind == "u":
            kind = "encoded_image"
        elif item.dtype.kind in "biuf":
            kind = "numeric"
        found.append({"key": key, "shape": list(item.shape), "dtype": str(item.dtype), "kind": kind})

    with stores.reader(path) as raw, h5py.File(raw, "r") as file:
        file.visititems(visit)
    return sorted(found, key=lambda x: x["key"])


class Hdf5Provider(SourceProvider):
    """Hierarchical-array recordings."""

    name = "hdf5"
    config_type = Hdf5Config

    def config_from_dict(self, raw: dict[str, Any]) -> Hdf5Config:
        made = dict(raw)
        made["fields"] = tuple(f if isinstance(f, NumericField) else NumericField(**f) for f in raw.get("fields", ()))
        made["videos"] = tuple(f if isinstance(f, VideoField) else VideoField(**f) for f in raw.get("videos", ()))
        return super().config_from_dict(made)

    def open(self, spark: SparkSession, root: str, config: Any = None) -> Dataset:
        return read_hdf5(spark, root, config or Hdf5Config())
