"""Vectorised text kernels shared by the training-data operators.

A *word* is a maximal run of ASCII letters, ASCII digits or non-ASCII
characters of the lower-cased text; everything else separates words.  Words
are found and hashed on the UTF-8 bytes of a whole Arrow column at a time, so
no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once.
SUB_BATCH_BYTES = 2 << 20
_SLICE = 1 << 18

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  not every C library has it
except (OSError, AttributeError):
    _LIBC = None

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _IS_WORD[_a:_b] = True

_BASE = np.uint64(0x9E3779B97F4A7C55)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Mixed hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n, _BASE, np.uint64)
            base[0] = 1
            inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        return self.up, self.down


_powers = _Powers()


@dataclass
class Words:
    """Words of a column: doc i has words first[i] to first[i + 1]."""

    data: np.ndarray  # bytes of the lower-cased column
    first: np.ndarray
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    hash: np.ndarray  # uint64

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix_hash(self, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n_bytes, and the hashes of their first n_bytes."""
        long = np.flatnonzero(self.end - self.start > n_bytes)
        at = self.start[long]
        up, _ = _powers(n_bytes)
        out = np.zeros(len(long), np.uint64)
        for k in range(n_bytes):
            out += (self.data[at + k].astype(np.uint64) + np.uint64(1)) * up[k]
        return long, mix64(out + np.uint64(n_bytes * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, and the offsets of its rows."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def clean(column: pa.Array) -> pa.Array:
    """Null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(column: pa.Array) -> Words:
    """Finds and hashes the words of every row; null has none."""
    data, offsets = column_bytes(pc.utf8_lower(clean(column)))
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    edge = np.zeros(n + 1, bool)  # no word runs over the edge of a row
    edge[offsets] = True
    while at < n:
        stop = min(n, at + _SLICE)
        while stop < n and _IS_WORD[data[stop]] and not edge[stop]:
            ahead = np.flatnonzero(~_IS_WORD[data[stop : stop + 65536]] | edge[stop : min(n, stop + 65536)])
            stop = stop + int(ahead[0]) if len(ahead) else min(n, stop + 65536)
        piece = data[at:stop]
        is_word, cut = _IS_WORD[piece], edge[at : stop + 1]
        before, after = np.empty_like(is_word), np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        before[cut[:-1]] = False
        after[-1], after[:-1] = False, is_word[1:]
        after[cut[1:]] = False
        s, e = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        up, down = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix64((total[e] - total[s]) * down[s]))
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(data, np.searchsorted(start, offsets), start, end, hashed)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the word at which each begins."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = len(hashes) - n + 1
    out = np.zeros(room, np.uint64)
    for k in range(n):
        out += hashes[k : k + room] * _POWERS_OF_N[k]
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)[:room]
    at = np.flatnonzero(np.arange(room) + n <= last)
    return mix64(out[at]), at


_POWERS_OF_N = np.multiply.accumulate(np.full(64, np.uint64(0xD1342543DE82EF95)))


def sequence_hash(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's whole sequence of words."""
    n = np.diff(first).astype(np.uint64)
    place = (np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)) * _GOLD
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix64(mix64(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + place), out=total[1:])
    return mix64(total[first[1:]] - total[first[:-1]] + n * _MIX1)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of every run of n words, by row and element.

    Elements have 44 bits.  A row of 1 to n - 1 words has one shingle, all its
    words; a row without words has none.  Repeats are kept.
    """
    hashed, at = ngrams(w.hash, w.first, n)
    row = np.repeat(np.arange(len(w.first) - 1), w.counts())[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
    if len(short):
        own = sequence_hash(w.hash, w.first, 77)[short]
        hashed, row = np.concatenate([hashed, own]), np.concatenate([row, short])
    assert len(w.first) - 1 < 1 << 20
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)))
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def occurrences(row: np.ndarray, element: np.ndarray) -> np.ndarray:
    """A hash for each (element, how many times it came before in the row).

    A multiset of elements thus becomes a set, and the weighted Jaccard
    similarity of two multisets is the Jaccard similarity of the two sets.
    """
    if not len(row):
        return np.zeros(0, np.uint64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return mix64(element * _GOLD + nth.astype(np.uint64) * _MIX2)


def release() -> None:
    """Gives freed memory back to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column``, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            stop = min(stop, at + (1 << 17), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
    release()


def dart_signatures(row: np.ndarray, token: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """DartMinHash: k coordinates for each row's set of tokens, and which rows have tokens.

    Every token owns a strip of unit width on which darts arrive as a Poisson
    process of unit rate; gaps between arrivals come from hashing the token, so
    equal tokens get equal darts in all rows.  An element of weight w is w such
    strips.  A dart falls on the coordinate that its hash names, and each
    coordinate keeps its earliest dart.  Two rows agree on a coordinate with
    probability equal to the weighted Jaccard similarity.  Only darts up to
    rank (k ln k + 2.5 k) / weight are thrown: that fills nearly all rows'
    coordinates; rows with a gap throw on to twice the rank.
    """
    out = np.zeros((n_rows, k), np.uint64)
    weight = np.bincount(row, minlength=n_rows)
    throw = k * (math.log(k) + 2.5)
    limit = np.divide(throw, weight, out=np.zeros(n_rows), where=weight > 0)
    todo, begin = weight > 0, np.searchsorted(row, np.arange(n_rows + 1))
    while todo.any():
        if todo.all():
            t, r = token, row
        else:
            rows = np.flatnonzero(todo)
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in rows])
            t, r = token[at], row[at]
        x = mix64(t ^ _GOLD)
        rank = -np.log(uniform(x))
        slots, ranks, names = [], [], []
        while True:
            near = np.flatnonzero(rank <= limit[r])
            if not len(near):
                break
            x, rank, r = x[near], rank[near], r[near]
            name = mix64(x + _MIX1)
            slots.append(r * k + (name >> np.uint64(32)).astype(np.int64) % k)
            ranks.append(rank)
            names.append(name)
            x = mix64(x + _GOLD)
            rank = rank - np.log(uniform(x))
        slot, name = np.concatenate(slots), np.concatenate(names)
        order = np.argsort(np.concatenate(ranks))[::-1]  # the earliest dart writes last
        flat = out.reshape(-1)
        full = np.zeros(n_rows * k, bool)
        flat[slot[order]] = name[order]
        full[slot] = True
        todo = todo & ~full.reshape(n_rows, k).all(axis=1)
        limit = limit * 2
    return out, weight > 0


def band_hashes(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One hash for each band of ``width`` coordinates."""
    out = np.zeros((len(signature), bands), np.uint64)
    for k in range(width):
        out += signature[:, k : bands * width : width] * _POWERS_OF_N[k]
    return mix64(out + np.arange(bands, dtype=np.uint64) * _GOLD)
