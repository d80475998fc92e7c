"""Token ids in sorted-string-table shards.

A shard file holds, in order:

* ``MAGIC``;
* data blocks, each zstd-compressed: entries in key order, where an entry is
  the number of key bytes shared with the entry before, the number of other
  key bytes, those bytes, the number of ids (uint32) and the ids (uint16 or
  uint32, little-endian);
* the index: for each block its last key, offset, length, raw length, entries
  and ids before it;
* a Bloom filter over the keys;
* the footer, of fixed length: where index and filter are, how many entries
  and ids there are, the bytes of an id, a checksum of index and filter, MAGIC.

A key is a zero byte for a missing id, or a one and the id as 8 bytes, big
endian with the sign bit flipped, so that keys sort as ids do.  A lookup asks
the filter, bisects the index and unpacks one block.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores
from . import textkit as tk
from .staging import new_path, table

MAGIC = b"STRNDSS1"
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Bytes of text that a shard holds at most, about; what text comes to for each byte in its files.
SHARD_BYTES, UNPACKED = 256 << 20, 4
#: Documents that a reader hands on together.
READ_ROWS = 20_000
_FOOTER = struct.Struct("<QQQQQQHI8s")
_ENTRY = struct.Struct("<QQQQQ")
_MISSING = b"\x00"


def key_of(doc_id: int | None) -> bytes:
    return _MISSING if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == _MISSING else int.from_bytes(key[1:], "big") - (1 << 63)


def _places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5EED) | 1
    return [(a + k * b + k * k) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Appends (id, ids as bytes) in ascending order of id."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.block, self.size, self.entries, self.before = [], 0, 0, 0
        self.last = b""
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, bytes]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        head = bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<I", len(ids) // self.width)
        self.block += (head, ids)
        self.size += len(head) + len(ids)
        self.entries += 1
        self.n_ids += len(ids) // self.width
        self.last = key
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        raw = b"".join(self.block)
        packed = pa.compress(raw, "zstd", asbytes=True)
        self.out.write(packed)
        self.index.append((self.last, _ENTRY.pack(self.at, len(packed), len(raw), self.entries, self.before)))
        self.at += len(packed)
        self.block, self.size, self.entries, self.before = [], 0, 0, self.n_ids

    def close(self) -> tuple[int, int]:
        self._flush()
        index = b"".join(bytes((len(k),)) + k + e for k, e in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_places(key, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.n_ids, self.width, zlib.crc32(index + packed), MAGIC))
        return len(self.keys), self.n_ids


class Reader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        file.seek(file.tell() - _FOOTER.size)
        at, length, bloom_at, self.bits, self.n_entries, self.n_ids, self.width, check, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        file.seek(at)
        index, bloom = file.read(length), file.read((self.bits + 7) // 8)
        if zlib.crc32(index + bloom) != check or bloom_at != at + length:
            raise ValueError("the index of a shard file is damaged")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8))
        self.last: list[bytes] = []
        self.blocks: list[tuple[int, ...]] = []
        p = 0
        while p < len(index):
            n = index[p]
            self.last.append(index[p + 1 : p + 1 + n])
            self.blocks.append(_ENTRY.unpack_from(index, p + 1 + n))
            p += 1 + n + _ENTRY.size

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, length, raw_length, entries, _ = self.blocks[k]
        self.file.seek(at)
        raw = pa.decompress(self.file.read(length), raw_length, "zstd", asbytes=True)
        p, key = 0, b""
        for _ in range(entries):
            shared, rest = raw[p], raw[p + 1]
            key = key[:shared] + raw[p + 2 : p + 2 + rest]
            p += 2 + rest
            (n,) = struct.unpack_from("<I", raw, p)
            p += 4
            yield key, np.frombuffer(raw, f"<u{self.width}", n, p).astype("<u4")
            p += n * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id lists of a document, one for each time it was written."""
        key = key_of(doc_id)
        if not self.bloom[_places(key, self.bits)].all():
            return []
        found = []
        for k in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            own = [ids for other, ids in self._block(k) if other == key]
            found += own
            if self.last[k] > key:
                break
        return found


class WordTable:
    """Token ids of texts by a table of distinct words.

    The tokenizer lowers its input, cuts it into runs of letters, single digits,
    runs of other characters and a few contractions, drops white space and never
    joins across a cut; so the ids of a text are those of its words, and the
    library encodes each distinct word once.  Texts of PLAIN characters are cut
    as the tokenizer cuts them.  Any other text is cut at blanks alone, where the
    tokenizer's normaliser cannot join either, and the library does the rest.
    """

    #: Words of a generation.  A full young table becomes the old one, and words that are met again return from it.
    LIMIT = 400_000
    #: What parts the words that the library is given together, and how many these are.
    SEPARATOR, LINE = "|", 64
    _BLANK = re.compile(r"[^ \n\r\t]+")
    # letters of Latin blocks that are their own composed form; no other white space than blanks
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
    # fixed value: the tokenizer's own cuts, for those characters in lower case; no two of them begin alike but the last
    _WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \n\r\ta-z0-9\u00df-\u00f6\u00f8-\u024f]+")

    # letters that are their own lower-case and composed form, if they are in lower case
    _LATIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+")

    def __init__(self, file: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 and end < 1 << 16 else 4
        self.end = end.to_bytes(self.width, "little")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # the same merges without the work that words of lower-case letters do not need
        lean, latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.lean = [(lambda w: w.isascii() and w.isalpha() and w.islower(), lean), (lambda w: not w.isascii() and self._LATIN.fullmatch(w) and w == w.lower(), latin)]
        alone = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        #: The id of SEPARATOR, if it is one, and stands between words as it stands alone.
        self.separator = alone[0] if len(alone) == 1 and all(t.encode(f"a {self.SEPARATOR} b", add_special_tokens=False).ids[1:-1] == alone for t in (lean, latin)) else None

    def words(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return self._WORD.findall(text.lower())
        return self._BLANK.findall(text)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def learned(self, fresh: list[str]) -> dict[str, bytes]:
        """The ids of words by the library.

        Words of lower-case letters go to it in lines, parted by SEPARATOR, whose
        one id then parts the ids; a line that does not come apart into as many
        words is encoded word by word, and so are all other words.
        """
        out: dict[str, bytes] = {}
        for fits, tool in self.lean if self.separator is not None else ():
            own = [w for w in fresh if fits(w)]
            lines = [own[i : i + self.LINE] for i in range(0, len(own), self.LINE)]
            coded = tool.encode_batch_fast([f" {self.SEPARATOR} ".join(line) for line in lines], add_special_tokens=False)
            for line, e in zip(lines, coded, strict=True):
                ids = np.array(e.ids, f"<u{self.width}")
                edges = (np.flatnonzero(ids == self.separator) * self.width).tolist()
                if len(edges) == len(line) - 1:
                    raw, begins = ids.tobytes(), [0, *(c + self.width for c in edges)]
                    out.update(zip(line, (raw[a:b] for a, b in zip(begins, [*edges, len(raw)], strict=True)), strict=True))
        rest = [w for w in fresh if w not in out]
        if rest:
            out.update((w, self._bytes(e.ids)) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes, the end id last."""
        cut = [self.words(t) for t in texts]
        if len(self.young) >= self.LIMIT:
            self.old, self.young = self.young, {}
        known = self.young
        new = set().union(*cut).difference(known)
        back = {w: self.old[w] for w in new.intersection(self.old)}
        known.update(back)
        known.update(self.learned(list(new.difference(back))))
        return [b"".join(map(known.__getitem__, words)) + self.end for words in cut]


_tables: dict[tuple[str, int], WordTable] = {}


def word_table(file: str, end: int) -> WordTable:
    """One table for each tokenizer and process."""
    if (file, end) not in _tables:
        _tables[file, end] = WordTable(file, end)
    return _tables[file, end]


def _shards_for(docs: DataFrame) -> int:
    """As many shards as the session has shuffle partitions, or more, so that none holds more than about SHARD_BYTES of text."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known > 1 << 58:  # the plan cannot tell
        known = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        return max(least, -(-known // SHARD_BYTES))
    return max(least, -(-known * UNPACKED // SHARD_BYTES))


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end: int) -> list[tuple[str, int, int]]:
    """Writes all documents in ascending order of id; (file, documents, ids) of each shard in that order.

    A shard is a range of ids (sampled splitters; rows that share an id are told
    apart by a hash of their text) and a task.  It is written under a hidden name
    of the attempt and renamed when whole, so a lost or repeated task leaves the
    same file and a failed one nothing.  The driver gets one row for each shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(tokenizer_file, end)
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}.sst"
        n = (0, 0)

        def fill(out) -> None:
            nonlocal n
            writer = Writer(out, words.width)
            for batch in chain([first], parts):
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_batch(tk.clean(batch.column(1)).to_pylist()), strict=True):
                    writer.add(doc_id, ids)
            n = writer.close()

        parts = tk.sub_batches(batches, "text", 2 << 20)
        first = next(parts, None)
        if first is not None:
            stores.write(f"{folder}/{name}", context.taskAttemptId(), fill)
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], names=["part", "name", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    ranges = rows.repartitionByRange(_shards_for(docs), *order).sortWithinPartitions(*order, "text")
    done = ranges.mapInArrow(run, "part int, name string, n bigint, ids bigint").collect()
    return [(f"{folder}/{r['name']}", r["n"], r["ids"]) for r in sorted(done, key=lambda r: r["part"])]


def read_shards(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone, READ_ROWS at a time."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns: tuple[list, ...] = ([], [], [], [])
                at = start
                with stores.reader(path) as file:
                    for doc_id, ids in Reader(file).scan():
                        for column, value in zip(columns, (doc_id, at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            column.append(value)
                        at += len(ids)
                        if len(columns[0]) == READ_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
                            columns = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], schema)
    starts = np.concatenate([[0], np.cumsum([s[2] for s in shards])[:-1]])
    listed = spark.createDataFrame([(s[0], int(a)) for s, a in zip(shards, starts, strict=True)], "path string, start bigint")
    return listed.repartition(len(shards)).mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer_file: str, end: int) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads them back.

    Null text counts as empty and has the end id alone.  Rows that repeat an id
    are written each, ordered by a hash of their text and the text; rows without
    an id come first.  Extra columns are ignored; an empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, new_path(spark, "sst"), tokenizer_file, end))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
