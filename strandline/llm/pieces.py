"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the unmarked text behind it.  No
piece of a model that ``Chunker`` accepts holds a marker behind another
character, so no merge crosses the border of two chunks: the ids of a text are
those of its chunks in order.  Every task segments each distinct chunk once,
by the library, and joins the ids back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .staging import table

MARK = "▁"
#: Chunks that a task remembers; the table starts anew beyond.
TABLE_CHUNKS = 100_000
#: Longer chunks are not remembered.
TABLE_CHARS = 200
# a space or a marker opens a chunk; the rest runs up to the next one
_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class Chunker:
    """Encodes and decodes whole texts with one model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b ﬁ Å"
        plain = self.model.decode(self.model.encode(probe)) == probe
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        #: Whether chunks are independent; a model for which they are not is run on whole texts.
        self.by_chunk = plain and not crossing and self.model.encode("a b")[:1] == self.model.encode("a") and pieces[self.model.encode("a")[0]].startswith(MARK)
        self.end = self.model.eos_id()
        self.table: dict[str, bytes] = {}
        self.lead = len(self.model.encode("a"))
        self.end_bytes = np.int32(self.end).tobytes()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Segments chunks that the table lacks, in two calls of the library.

        The dummy marker of a text stands for the marker of a chunk that has
        just one; a chunk with more is segmented behind a letter, whose ids go.
        """
        single = [c for c in chunks if c[0] == " " and len(c) > 1 and c[1] not in (" ", MARK)]
        others = sorted(chunks.difference(single))
        ids = [*self.model.encode([c[1:] for c in single]), *(x[self.lead :] for x in self.model.encode(["a" + c for c in others]))]
        return {c: np.array(x, np.int32).tobytes() for c, x in zip([*single, *others], ids, strict=True)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, the end id last."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts] if self.by_chunk else []
        if len(self.table) >= TABLE_CHUNKS:
            self.table.clear()
        new = set().union(*cut).difference(self.table)
        learned = self._learn(new) if new else {}
        known = self.table
        known.update((c, x) for c, x in learned.items() if len(c) <= TABLE_CHARS)
        long = {c: x for c, x in learned.items() if len(c) > TABLE_CHARS}
        find = (lambda c: long[c] if c in long else known[c]) if long else known.__getitem__
        if not self.by_chunk:
            return [np.array([*self.model.encode(t), self.end], np.int32) for t in texts]
        return [np.frombuffer(b"".join(map(find, chunks)) + self.end_bytes, np.int32) for chunks in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_chunkers: dict[str, Chunker] = {}


def chunker(model_file: str) -> Chunker:
    """One chunker for each model file and process."""
    if model_file not in _chunkers:
        _chunkers[model_file] = Chunker(model_file)
    return _chunkers[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (the end id last) for every row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = chunker(model_file)
        for batch in tk.sub_batches(batches, "text", 2 << 20):
            ids = tool.encode_batch(tk.clean(batch.column(1)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])

    return _input(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text for rows of (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = chunker(model_file)
        for batch in batches:
            texts = [tool.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``.

    The digests are taken where the ids are made, so neither ids nor decoded
    texts leave the task.  Null text counts as empty and has the end id alone;
    repeated rows repeat, a missing id stays missing, extra columns are ignored
    and an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = chunker(model_file)
        decimal = [str(i) for i in range(tool.model.get_piece_size())].__getitem__
        for batch in tk.sub_batches(batches, "text", 2 << 20):
            n, coded, decoded = [], [], []
            for row in tool.encode_batch(tk.clean(batch.column(1)).to_pylist()):
                ids = row.tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
