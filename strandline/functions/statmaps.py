"""Statistics of features: structs of arrays, shifted, made constant or laid out wide."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import q

#: Statistics that move with a constant added to every value.
_MOVING = ("min", "max", "mean")
_QUANTILE = re.compile(r"q\d+$")


def shift_stats(stats: dict[str, Column], delta: Column) -> dict[str, Column]:
    """Adds ``delta`` to min, max, mean and quantiles, which are numbers; std and count stay."""
    return {k: (v + delta if k in _MOVING or _QUANTILE.match(k) else v) for k, v in stats.items()}


def constant_stats(value: Column, length: Column, template: tuple[str, ...]) -> dict[str, Column]:
    """The statistics of a column that holds ``value`` in ``length`` rows, for the template's keys alone."""
    known = {"std": F.lit(0.0), "count": length.cast("bigint")}
    return {k: known.get(k, value.cast("double")) for k in template}


def flatten_stats(df: DataFrame, stats: str, features: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Map of maps to columns ``stats/<feature>/<key>``; a missing entry is null."""
    wide = [F.try_element_at(F.try_element_at(q(stats), F.lit(f)), F.lit(k)).alias(f"stats/{f}/{k}") for f in sorted(features) for k in keys]
    return df.select(*(q(c) for c in df.columns if c != stats), *wide)


def nest_stats(columns: list[str]) -> dict[str, dict[str, str]]:
    """feature -> key -> column, from wide names read from the right."""
    out: dict[str, dict[str, str]] = {}
    for name in columns:
        if name.startswith("stats/"):
            feature, key = name[len("stats/") :].rsplit("/", 1)
            out.setdefault(feature, {})[key] = name
    return out
