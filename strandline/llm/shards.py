"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours and
go to one shard.  A sample of keys, drawn with probability proportional to
size, gives quantile boundaries; records are dealt into the ranges between
them, ranges that hold too many bytes are cut again by a sample of their own,
and whole ranges are then given to shards, the largest first, each to the shard
with the fewest bytes.

Only a slim table (id, size, checksum, key) is written and shuffled; no text is.
Rows that agree in all four are one row with a count, folded before the shuffle.
Slots come from counts of bounded pieces: a range is cut by a hash of the id
into pieces of about PIECE_ROWS such rows, these are numbered within a piece,
and pieces are offset by the rows before them.  So neither a shard nor a group
of copies, with ids or without, is ever numbered in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import small, stage, table

N_SHARDS = 16
#: Ranges for each shard at least, and bytes of a range at most where there are more.
RANGES_PER_SHARD = 64
RANGE_BYTES = 1 << 30
#: Sampled keys for each range.
SAMPLES = 24
#: A range with more than this multiple of the mean is cut again.
OVERFULL = 2.0
PIECE_ROWS = 4000
#: Equal rows that are written out together at most.
STRETCH = 65_536
#: Pieces come back to the driver as counts; with more rows a piece holds more.
MAX_PIECES = 400_000


def _ranges_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, keys, side="right")


def _dealt(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds the range of each row; the splitters are a bounded array: a few for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("key")
            ranges = _ranges_of(batch.column(at).to_numpy(), splitters).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges)], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, "doc_id bigint, size bigint, text_crc32 bigint, key bigint, n bigint, range int")


def _sample(rows: DataFrame, wanted: float, total: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with probability proportional to size, with the bytes that each stands for."""
    rate = wanted / max(1, total)
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    size = F.col("size") * F.col("n")
    drawn = rows.where(draw < size * rate).select("key", F.greatest(size.cast("double"), F.lit(1 / rate)).alias("stands"))
    got = drawn.groupBy("key").agg(F.sum("stands").alias("stands")).orderBy("key").collect()
    return np.array([r["key"] for r in got], np.int64), np.array([r["stands"] for r in got], float)


def _quantiles(keys: np.ndarray, stands: np.ndarray, n: int) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, np.int64)
    total = np.cumsum(stands)
    at = np.searchsorted(total, total[-1] * np.arange(1, n) / n)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def splitters_for(rows: DataFrame, total: int, n_ranges: int) -> tuple[np.ndarray, dict[int, int]]:
    """Boundaries of the ranges, and the bytes of each range by exact count.

    Overfull ranges are cut until none is left that holds more than one key.
    """
    splitters, salt = _quantiles(*_sample(rows, n_ranges * SAMPLES, total, 0), n_ranges), 0
    limit = OVERFULL * total / n_ranges
    while True:
        counted = _dealt(rows, splitters).groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        size = {r["range"]: r["b"] for r in counted}
        over = {r["range"]: (r["lo"], r["hi"]) for r in counted if r["b"] > limit and r["lo"] < r["hi"]}
        if not over:
            return splitters, size
        salt += 1
        inside = _dealt(rows, splitters).where(F.col("range").isin(sorted(over))).drop("range")
        heavy_bytes = sum(size[k] for k in over)
        keys, stands = _sample(inside, SAMPLES * 4.0 * len(over) + heavy_bytes / total * n_ranges * SAMPLES, heavy_bytes, salt)
        home = _ranges_of(keys, splitters)
        more = []
        for k, (lo, hi) in sorted(over.items()):
            own = np.flatnonzero(home == k)
            if len(own) > 1:
                more.append(_quantiles(keys[own], stands[own], int(np.ceil(2 * size[k] / limit)) + 1))
            # a key that alone outweighs a range gets a range of its own; the least key always does, so every round cuts
            heavy = np.append(keys[own][stands[own] > limit / 4], lo)
            more.append(np.concatenate([heavy, heavy + 1]))
        splitters = np.unique(np.concatenate([splitters, *more]))


def deal_ranges(size: dict[int, int], n_shards: int) -> dict[int, int]:
    """Shard of each range: the largest range first, to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for r in sorted(size, key=lambda k: (-size[k], k)):
        b, s = heapq.heappop(heap)
        out[r] = s
        heapq.heappush(heap, (b + size[r], s))
    return out


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    The law is ``bytes``: shards are nearly equal in bytes, as far as whole
    groups of equal texts allow (a group heavier than its share fills a shard of
    its own).  size is the UTF-8 bytes of the text (null: none) plus 1; null and
    the empty text are one group.  slot numbers the rows of a shard from 0
    without gaps; repeated rows get slots of their own, and so do rows without
    an id.  Extra columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = stage(slim.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("n")), "slim")
    whole = rows.agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n_rows = whole["b"] or 0, whole["n"]
    n_ranges = max(n_shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    splitters, size = splitters_for(rows, total, n_ranges)
    home = deal_ranges(size, n_shards)

    piece_rows = max(PIECE_ROWS, -(-n_rows * 2 // MAX_PIECES))
    dealt = _dealt(rows, splitters)
    many = {r["range"]: max(1, -(-r["n"] // piece_rows)) for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    # one row for each range: bounded by MAX_PIECES and the ranges
    ranges = small(spark.createDataFrame([(k, home[k], many[k]) for k in sorted(many)], "range int, shard int, pieces int"))
    placed = dealt.join(ranges, "range").withColumn("piece", F.pmod(F.xxhash64("doc_id", "key"), F.col("pieces").cast("long")).cast("int"))
    counts = placed.groupBy("shard", "range", "piece").agg(F.sum("n").alias("n")).orderBy("shard", "range", "piece").collect()
    offset, at = [], dict.fromkeys(range(n_shards), 0)
    for r in counts:
        offset.append((r["range"], r["piece"], at[r["shard"]]))
        at[r["shard"]] += r["n"]
    offsets = small(spark.createDataFrame(offset, "range int, piece int, before bigint"))
    within = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("upto", F.sum("n").over(within)).join(offsets, ["range", "piece"])
    stop = F.col("before") + F.col("upto")
    numbered = stage(numbered.select("doc_id", "size", "text_crc32", "shard", "n", (stop - F.col("n")).alias("first"), stop.alias("stop")), "numbered")
    # a row that repeats very often is written out by many tasks, a stretch of slots each
    often = numbered.where(F.col("n") > STRETCH).withColumn("first", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(STRETCH).cast("long"))))
    often = often.withColumn("stop", F.least(F.col("first") + STRETCH, "stop")).repartition("doc_id", "text_crc32", "first")
    each = numbered.where(F.col("n") <= STRETCH).unionByName(often).withColumn("slot", F.explode(F.sequence("first", F.col("stop") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
