"""Packing episodes into files, and cutting them into even intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import dense_rank_of


def greedy_groups(sizes: list[int], limit: int) -> list[int]:
    """Group of each item in order: a group closes when the next item would bring it to the limit."""
    group, filled, out, empty = 0, 0, [], True
    for size in sizes:
        if not empty and filled + size >= limit:
            group, filled = group + 1, 0
        filled += size
        empty = False
        out.append(group)
    return out


def greedy_pack(episodes: DataFrame, *, key: str, size: str, limit: int, name: str = "file_index") -> DataFrame:
    """Adds the file of each episode; an item of the limit or more is alone in its file.

    Where a file closes depends on all items before, so the fold is sequential
    by definition.  It runs over two numbers for each episode (never over
    frames) as batches in order, in constant memory.
    """
    schema = f"{key} {episodes.schema[key].dataType.simpleString()}, {name} int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, filled, empty = 0, 0, True
        for batch in batches:
            out = []
            for s in batch[size]:
                if not empty and filled + s >= limit:
                    group, filled = group + 1, 0
                filled += s
                empty = False
                out.append(group)
            yield pd.DataFrame({key: batch[key], name: pd.Series(out, dtype="int32")})

    ordered = episodes.select(key, size).repartition(1).sortWithinPartitions(key)
    return episodes.join(ordered.mapInPandas(fold, schema), key)


def greedy_pack_within(rows: DataFrame, *, by: str, key: str, size: str, limit: int, breaks: str | None = None, name: str = "file") -> DataFrame:
    """Adds the file of each row, packed as greedy_pack does but for each value of ``by``; a new value of ``breaks`` closes a file.

    A value of ``by`` is folded as batches in order, in constant memory.
    """
    columns = [by, key, size, *([breaks] if breaks else [])]
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, {name} bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, kind, group, filled, empty = None, None, 0, 0, True
        for batch in batches:
            out = []
            for o, s, k in zip(batch[by], batch[size], batch[breaks] if breaks else batch[by], strict=True):
                if o != owner:
                    owner, kind, group, filled, empty = o, k, 0, 0, True
                if not empty and (filled + s >= limit or k != kind):
                    group, filled = group + 1, 0
                filled, kind, empty = filled + s, k, False
                out.append(group)
            yield pd.DataFrame({by: batch[by], key: batch[key], name: out})

    ordered = rows.select(*columns).repartition(by).sortWithinPartitions(by, key)
    return rows.join(ordered.mapInPandas(fold, schema), [by, key])


def even_intervals(episodes: DataFrame, *, key: str, count: int | None = None, name: str = "part") -> DataFrame:
    """Adds the part of each episode: ``count`` contiguous parts whose lengths differ by one at most.

    The first parts take what remains; by default there are up to 32 parts.
    Ranks come from block sums, so no task holds all episodes.
    """
    total = episodes.count()
    parts = max(1, min(total, 32) if count is None else min(count, max(total, 1)))
    size, rest = divmod(total, parts)
    ranked = dense_rank_of(episodes, key, "__rank")
    edge = rest * (size + 1)
    part = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (size + 1))).otherwise(F.lit(rest) + F.floor((F.col("__rank") - edge) / max(size, 1)))
    return ranked.withColumn(name, part.cast("int")).drop("__rank")
