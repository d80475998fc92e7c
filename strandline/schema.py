"""Declared features and the Spark types that carry them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Spark type of each declared dtype; unsigned types are widened and half floats become floats.
LEAVES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(),
}
SYSTEM_FEATURES = {"timestamp": "float32", "frame_index": "int64", "episode_index": "int64", "index": "int64", "task_index": "int64"}


@dataclass(frozen=True)
class Feature:
    """One column of a dataset: dtype, shape, names and whatever else its metadata holds."""

    dtype: str
    shape: tuple[int, ...] = (1,)
    names: Any = None
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Feature:
        return cls(raw["dtype"], tuple(raw.get("shape") or (1,)), raw.get("names"), {k: v for k, v in raw.items() if k not in ("dtype", "shape", "names")})

    def to_json(self) -> dict[str, Any]:
        return {"dtype": self.dtype, "shape": list(self.shape), "names": self.names, **self.extra}

    @property
    def is_media(self) -> bool:
        return self.dtype == "video"


def video_keys(features: dict[str, Feature]) -> list[str]:
    return sorted(k for k, f in features.items() if f.is_media)


def normalized(features: dict[str, Feature]) -> dict[str, dict[str, Any]]:
    """Features as compared between datasets: the rate noted on a non-video feature does not count."""
    out = {}
    for name, f in features.items():
        raw = f.to_json()
        if not f.is_media:
            raw.pop("fps", None)
        out[name] = raw
    return out


def with_depth(leaf: T.DataType, depth: int) -> T.DataType:
    for _ in range(depth):
        leaf = T.ArrayType(leaf)
    return leaf


def leaf_of(kind: T.DataType) -> tuple[T.DataType, int]:
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    return kind, depth


def canonical_types(physical: T.StructType, features: dict[str, Feature]) -> T.StructType:
    """The physical schema with declared leaf types; nesting and undeclared columns stay."""
    fields = []
    for f in physical.fields:
        leaf, depth = leaf_of(f.dataType)
        declared = features.get(f.name)
        if declared and declared.dtype in LEAVES:
            leaf = LEAVES[declared.dtype]
        fields.append(T.StructField(f.name, with_depth(leaf, depth), True))
    return T.StructType(fields)


def repaired_shape(declared: tuple[int, ...], actual: tuple[int, ...]) -> tuple[int, ...]:
    """The actual shape, if the declared one differs by leading ones alone; else an error."""
    trimmed = declared
    while len(trimmed) > len(actual) and trimmed and trimmed[0] == 1:
        trimmed = trimmed[1:]
    if trimmed == actual or (declared == (1,) and actual == ()):
        return actual or declared
    raise ValueError(f"declared shape {declared} does not fit values of shape {actual}")


def nested_shape(value: Any) -> tuple[int, ...]:
    """Shape of a nested list; ragged and empty lists are errors."""
    if not isinstance(value, list | tuple):
        return ()
    if not value:
        raise ValueError("an empty list has no shape")
    inner = {nested_shape(v) for v in value}
    if len(inner) != 1:
        raise ValueError("a ragged list has no shape")
    return (len(value), *inner.pop())
