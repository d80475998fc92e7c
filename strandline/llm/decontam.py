"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One step over all texts, which are not shuffled: every task joins the n-grams of
its texts to those of the items, cuts the window around each diagonal band of
hits, and aligns item and window word by word.

All n-grams of an item are seeds, however many documents hold them.  Thinning by
document frequency would lose edited copies of an item that the corpus repeats:
its rarest n-grams are those that the edits broke.  A window is so wide that an
alignment through its seeds that reaches MIN_SCORE lies in it.  What shares no
n-gram of SEED_WORDS words with an item is not aligned to it.  Such a text, if
it has substituted or missing words alone, scores no more than (3 k + 4) /
(6 k + 4) for an item of 3 k + 2 words: close to MIN_SCORE but for short items.
One with a word put in after every second word of the item scores 0.75 and
escapes as well.

The items are the side that is small: they are collected only after their size
has been checked against MAX_ITEM_BYTES, and broadcast once as flat arrays; a
larger benchmark is cut into parts of that size, each of which runs the same
steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .staging import quoted, small, stage, table, unused

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible score that an alignment must reach.
MIN_SCORE = 0.5
MAX_ITEM_BYTES = 16 << 20

_HITS = "doc_id bigint, item_id bigint, score double, matched bigint, item_words bigint, start bigint, stop bigint"


class Items:
    """Benchmark items as word hashes, with their n-grams, in flat arrays.

    The places of n-gram ``grams[k]`` are ``item`` and ``at`` from ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        w = tk.words(pa.array([r[1] for r in rows], pa.large_string()))
        self.words, self.begin = w.hash, w.first
        length = w.counts()
        #: Lengths of n-grams: an item shorter than SEED_WORDS is a seed as a whole.
        self.sizes = sorted(set(np.minimum(length[length > 0], SEED_WORDS).tolist()))
        grams, items, places = [], [], []
        for n in self.sizes:
            g, at = tk.ngrams(w.hash, w.first, n)
            owner = np.searchsorted(w.first, at, side="right") - 1
            own = np.minimum(length[owner], SEED_WORDS) == n
            grams.append(g[own])
            items.append(owner[own].astype(np.int32))
            places.append((at - w.first[owner])[own].astype(np.int32))
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item = np.concatenate(items)[order] if items else np.zeros(0, np.int32)
        self.at = np.concatenate(places)[order] if places else np.zeros(0, np.int32)

    def text(self, i: int) -> np.ndarray:
        return self.words[self.begin[i] : self.begin[i + 1]]

    def hits(self, w: tk.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, word at which the item would begin) of every seed of a column, for each length."""
        bits = np.zeros(1 << 22, bool)
        bits[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        for n in self.sizes:
            grams, at = tk.ngrams(w.hash, w.first, n)
            near = np.flatnonzero(bits[(grams >> np.uint64(42)).astype(np.int64)])
            g, at = grams[near], at[near]
            k = np.searchsorted(self.grams, g)
            k[k == len(self.grams)] = 0
            found = np.flatnonzero(self.grams[k] == g)
            k, at = k[found], at[found]
            many = self.first[k + 1] - self.first[k]
            place = np.repeat(self.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            yield np.searchsorted(w.first, at, side="right") - 1, self.item[place], at - self.at[place]


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, matched words, begin and end in the window.

    Every cell carries where its alignment began and how many words it has
    matched, so two rows of the matrix are enough.
    """
    m = len(window)
    column = np.arange(m + 1)
    score, begin, matched = np.zeros(m + 1, np.int64), column.copy(), np.zeros(m + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        same = window == word
        diag = score[:-1] + np.where(same, MATCH, MISMATCH)
        above = score[1:] + GAP
        from_diag = diag >= above
        row, row_begin, row_matched = np.zeros(m + 1, np.int64), column.copy(), np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diag, above), 0)
        some = row[1:] > 0
        row_begin[1:] = np.where(some, np.where(from_diag, begin[:-1], begin[1:]), column[1:])
        row_matched[1:] = np.where(some, np.where(from_diag, matched[:-1] + same, matched[1:]), 0)
        # gaps along the row: each cell takes the one before it, or itself, that is best after its distance
        source = np.maximum.accumulate((row - GAP * column) * (m + 1) + column) % (m + 1)
        score = row[source] + GAP * (column - source)
        begin, matched = row_begin[source], row_matched[source]
        j = int(np.argmax(score))
        if score[j] > best[0]:
            best = (int(score[j]), int(matched[j]), int(begin[j]), j)
    return best


def _windows(begins: list[int], n: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text in which an item of ``n`` words may lie that begins near ``begins``.

    An alignment that reaches MIN_SCORE (n points) has n gaps at most, so it
    strays from a seed's diagonal by n words at most and is 2 n words long at
    most: pieces of 4 n words that step by 2 n hold it whole.
    """
    begins.sort()
    spans = [[begins[0], begins[0]]]
    for b in begins[1:]:
        if b - spans[-1][1] > n:
            spans.append([b, b])
        spans[-1][1] = b
    for a, b in spans:
        lo, hi = max(low, a - n), min(high, b + 2 * n)
        while hi - lo > 4 * n:
            yield lo, lo + 4 * n
            lo += 2 * n
        yield lo, hi


def _alignments(item: np.ndarray, text: np.ndarray, begins: list[int]) -> list[tuple[int, int, int, int]]:
    """(score, matched, begin, end) of alignments that reach MIN_SCORE and share no word of the text."""
    found: list[tuple[int, int, int, int]] = []
    todo = list(_windows(begins, len(item), 0, len(text)))[::-1]
    while todo:
        lo, hi = todo.pop()
        if np.isin(item, text[lo:hi]).sum() < MIN_SCORE * len(item):
            continue  # even with all shared words aligned the score stays below
        score, matched, s, e = smith_waterman(item, text[lo:hi])
        if score < MIN_SCORE * MATCH * len(item):
            continue
        found.append((score, matched, lo + s, lo + e))
        # another copy may stand before or behind this one
        todo += [(lo + e, hi), (lo, lo + s)]
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[0], x[2], x[3])):  # windows overlap, so an alignment may come twice or in part
        if all(x[3] <= y[2] or y[3] <= x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def _align(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in tk.sub_batches(batches, "text", 1 << 20):
            w = tk.words(batch.column(1))
            near: dict[tuple[int, int], list[int]] = defaultdict(list)
            for rows, owners, begins in items.hits(w):
                for row, i, begin in zip(rows.tolist(), owners.tolist(), begins.tolist(), strict=True):
                    near[row, i].append(begin)
            out = []
            for (row, i), begins in near.items():
                item, low = items.text(i), int(w.first[row])
                for score, matched, s, e in _alignments(item, w.hash[low : int(w.first[row + 1])], [b - low for b in begins]):
                    out.append((row, int(items.ids[i]), score / (MATCH * len(item)), matched, len(item), s, e))
            rows, *rest = zip(*out, strict=True) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.float64()), *(pa.array(x, pa.int64()) for x in rest[2:])], names=["doc_id", "item_id", "score", "matched", "item_words", "start", "stop"])

    return docs.mapInArrow(scan, _HITS)


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of a checked size."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // MAX_ITEM_BYTES))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else benchmark
        rows = [(r["item_id"], r["text"]) for r in part.collect()]
        if rows:
            yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each copy of an item in a document: doc_id, item_id, score, matched, item_words, start, stop.

    score is that of a local alignment over the item's best possible one,
    MIN_SCORE at least; start and stop are the aligned words of the document,
    and those of two rows of one document and item do not overlap.  Null or
    empty texts and items align with nothing, and so do items without an id.  Rows
    that repeat are reported as often; equal items are reported each.  Extra
    columns are ignored and empty tables give no rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    found = []
    for rows in _parts(asked):
        items = Items(rows)
        if not len(items.grams):
            continue
        found.append(_align(texts, items))
    if not found:
        return docs.sparkSession.createDataFrame([], _HITS)
    return reduce(DataFrame.union, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that align with no item, with all their columns.

    Rows without an id cannot be told apart: one that aligns takes all with it.
    """
    names, key = docs.columns, unused("gone", docs)
    hits = stage(contamination(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id").distinct(), "contaminated")
    gone = small(hits.select(F.col("doc_id").alias(key)))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_anti").select(*map(quoted, names))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
