"""Scalar expressions used by several operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RTOL, ATOL = 1e-6, 1e-7


def q(name: str) -> Column:
    """A column by its exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested_close(left: Column, right: Column, *, rtol: float = RTOL, atol: float = ATOL, nan_equal: bool = False) -> Column:
    """Whether two numbers agree; the tolerance is relative to the right one."""
    close = F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)
    both_nan = F.isnan(left) & F.isnan(right)
    either_nan = F.isnan(left) | F.isnan(right)
    return F.when(either_nan, both_nan if nan_equal else F.lit(False)).otherwise((left == right) | close)


def arrays_close(left: Column, right: Column) -> Column:
    """Whether two arrays of numbers have equal length and agree element by element."""
    return (F.size(left) == F.size(right)) & F.forall(F.zip_with(left, right, lambda a, b: F.coalesce(nested_close(a, b), F.lit(False))), lambda x: x)


def all_finite(values: Column, size: int | None = None) -> Column:
    """Whether an array has ``size`` elements, all of them finite."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite if size is None else (F.size(values) == size) & finite


def numeric_stem(path: Column) -> Column:
    """The number that a file name without its suffix spells, null if it spells none."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    return F.when(stem.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), stem.cast("double"))


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key with digit runs as numbers and text in lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), F.lpad(F.regexp_replace(r, r"^0+(?=[0-9])", ""), width, "0")).otherwise(r)), "\u0001")


def formatted(pattern: str, *, video_key: str | None = None, **numbers: Column) -> Column:
    """A path pattern with ``{name:03d}`` fields as an expression of columns; percent signs stand for themselves."""
    text, values = pattern.replace("%", "%%"), []
    if video_key is not None:
        text = text.replace("{video_key}", video_key.replace("%", "%%"))
    for m in re.finditer(r"\{(\w+)(?::(\w+))?\}", text):
        values.append(numbers[m.group(1)].cast("bigint"))
    return F.format_string(re.sub(r"\{\w+(?::(\w+))?\}", lambda m: "%" + (m.group(1) or "d"), text), *values)
