"""Exact duplicates by content sort.

Sampled splitters cut the order of the texts' bytes into ranges
(``repartitionByRange``; by the first characters, then by a hash where texts
share these, so that a sample stays small), an external sort puts equal texts next to each other
in a range, and full comparisons of neighbours find the groups.  Before the
shuffle every task folds the equal texts that it meets into one row, so a group
of copies reaches its range as a row from each task, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import quoted, small, stage, table, unused
from .textkit import sub_batches

_FOLDED = pa.schema([("text", pa.large_string()), ("keep_id", pa.int64()), ("n", pa.int64())])
_GROUPS = "text_sha256 string, keep_id bigint, group_size bigint"
#: Bytes of texts that a task remembers having met twice.
REMEMBERED_BYTES = 32 << 20
#: Leading characters of a text that order the ranges; texts that share them are told apart by a hash.
KEY_CHARS = 32
#: Digests up to which the groups with copies are broadcast: about 30 MB.
MULTIPLE = 250_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a task as one row: exactly within a batch, and across batches for texts met twice."""
    known: dict[str, list[int | None]] = {}
    room = REMEMBERED_BYTES

    def best(a: int | None, b: int | None) -> int | None:
        return b if a is None else a if b is None else max(a, b)

    for batch in sub_batches(batches, "text", 16 << 20):
        t = pa.Table.from_batches([batch]).group_by("text").aggregate([("doc_id", "max"), ("doc_id", "count"), ("text", "count")])
        text, top, n = t["text"].combine_chunks(), t["doc_id_max"].combine_chunks(), t["text_count"].to_numpy()
        if known:
            old = pc.index_in(text, pa.array(list(known), text.type))
            for i in np.flatnonzero(old.is_valid().to_numpy(zero_copy_only=False)):
                entry = known[text[int(i)].as_py()]
                entry[0], entry[1] = best(entry[0], top[int(i)].as_py()), entry[1] + int(n[i])
            fresh = pc.is_null(old)
        else:
            fresh = pa.array(np.ones(len(text), bool))
        for i in np.flatnonzero(fresh.to_numpy(zero_copy_only=False) & (n > 1)):
            key = text[int(i)].as_py()
            if len(key) * 4 > room:
                continue
            room -= len(key) * 4
            known[key] = [top[int(i)].as_py(), int(n[i])]
        if known:
            fresh = pc.invert(pc.is_in(text, pa.array(list(known), text.type)))
        yield pa.RecordBatch.from_arrays([x.filter(fresh) for x in (text.cast(pa.large_string()), top, pa.array(n))], schema=_FOLDED)
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.large_string()), pa.array([v[0] for v in known.values()], pa.int64()), pa.array([v[1] for v in known.values()], pa.int64())], schema=_FOLDED)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted range: a row is compared in full with the one before it."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    open_text: str | None = None
    open_id, open_n = None, 0

    def closed(texts: list[str], ids: list[int | None], sizes: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)

    for batch in sub_batches(batches, "text", 16 << 20):
        text = batch.column(0)
        new = np.ones(len(text), bool)
        new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        ids = batch.column(1)
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        low = np.iinfo(np.int64).min
        raw = np.where(has, pc.fill_null(ids, low).to_numpy(), low)
        top, some = np.maximum.reduceat(raw, begin), np.logical_or.reduceat(has, begin)
        n = np.add.reduceat(batch.column(2).to_numpy(), begin)
        texts = text.take(pa.array(begin)).to_pylist()
        out_ids = [int(t) if s else None for t, s in zip(top, some, strict=True)]
        sizes = [int(x) for x in n]
        if open_text is not None:
            if texts[0] == open_text:
                out_ids[0] = max((x for x in (out_ids[0], open_id) if x is not None), default=None)
                sizes[0] += open_n
            else:
                texts, out_ids, sizes = [open_text, *texts], [open_id, *out_ids], [open_n, *sizes]
        open_text, open_id, open_n = texts.pop(), out_ids.pop(), sizes.pop()
        if texts:
            yield closed(texts, out_ids, sizes)
    if open_text is not None:
        yield closed([open_text], [open_id], [open_n])


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id, group_size."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("long")
    sign = 1 if keep == "largest" else -1
    rows = docs.select((key * sign).alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    folded = rows.mapInArrow(_fold, "text string, keep_id bigint, n bigint")
    # splitters are sampled from a bounded key that equal texts share; the sort compares whole texts
    bounded = (F.substring("text", 1, KEY_CHARS), F.xxhash64("text"))
    ranges = folded.repartitionByRange(*bounded).sortWithinPartitions(*bounded, "text")
    groups = ranges.mapInArrow(_neighbours, _GROUPS)
    return groups.withColumn("keep_id", F.col("keep_id") * sign)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text; empty texts are equal to one another.
    Rows without an id count in group_size, but an id is kept before a missing
    one; in a group without ids keep_id is null and every row is kept.  Rows
    that repeat both id and text are one document listed twice and get the same
    answer.  Other columns of ``docs`` are neither read nor returned, whatever
    their names.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(normalise(text) if normalise else text, 256).alias("text_sha256"))
    # a text without copies keeps itself, so only the groups with copies are looked up: by broadcast while they are few, else by a join whose skewed side can be split
    groups = stage(duplicate_groups(docs, id_col=id_col, text_col=text_col, keep=keep, normalise=normalise).where("group_size > 1"), "copies")
    looked = rows.join(small(groups.select("text_sha256", F.col("keep_id").alias("best"), F.col("group_size").alias("n")), MULTIPLE), "text_sha256", "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return looked.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` whose text has no better copy, with all their columns; of repeated rows one stays.

    Only texts with copies are looked up, so while these are few (MULTIPLE
    digests, counted first) no text is shuffled again.  A group without any id
    keeps one row.
    """
    names = docs.columns
    sha, best_id, many = (unused(n, docs) for n in ("sha", "best", "many"))
    groups = duplicate_groups(docs, id_col=id_col, text_col=text_col, keep=keep).where("group_size > 1").select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(best_id), F.lit(True).alias(many))
    groups = small(stage(groups, "copies"), MULTIPLE)
    marked = docs.withColumn(sha, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).join(groups, sha, "left")
    single = marked.where(F.col(many).isNull())
    best = marked.where(F.col(many) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(best_id)))
    return single.select(*map(quoted, names)).unionByName(best.dropDuplicates([sha]).select(*map(quoted, names)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""
