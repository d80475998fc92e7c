"""Toxicity: a factorization machine over hashed terms.

Terms are words and the first 4 to 7 bytes of longer words, hashed into
BUCKETS buckets, and each term met again in the same text is a further term;
x is 1 for a term that the text has.  The score is

    sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

so a pair of terms (an insult and whom it names) can weigh more or less than
the two alone.  Terms are chosen by a weighted chi-square test on the training
rows, and the machine is fitted by mini-batch Adagrad on a bounded sample of
labelled rows (TRAIN_ROWS).  Copies in the sample share one vote: rows with the
same label and the same SKETCH least shingles, each by an order of its own,
weigh 1 / their number; a passage that texts share is not enough for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import textkit as tk
from .staging import stage, table

#: The most labelled rows used for training, those with the least hash of their id.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 21
PREFIXES = (4, 5, 6, 7)
TERMS = 3000
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE, DECAY = 0.2, 3e-5
#: Coordinates that copies have in common.
SKETCH = 8
THRESHOLD = 0.7
SEED = 7


def term_rows(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term of every row, with repeats."""
    owner = np.repeat(np.arange(len(w.first) - 1), w.counts())
    rows, terms = [owner], [w.hash]
    for n in PREFIXES:
        long, hashed = w.prefix_hash(n)
        rows.append(owner[long])
        terms.append(hashed)
    return np.concatenate(rows), (np.concatenate(terms) >> np.uint64(64 - 21)).astype(np.int64)


#: Flips a bucket to that of "this term, more than once", and back.
AGAIN = 0x15A5A5


def with_repeats(pair: np.ndarray) -> np.ndarray:
    """Distinct row * BUCKETS + bucket, with the buckets of repeated terms added; ascending."""
    once, n = np.unique(pair, return_counts=True)
    twice = once[n > 1]
    return np.unique(np.concatenate([once, twice // BUCKETS * BUCKETS + (twice % BUCKETS ^ AGAIN)]))


@dataclass
class Machine:
    """Weights of the chosen buckets."""

    buckets: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs of a column, each once, by row."""
        n = len(self.buckets)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.full(BUCKETS, -1, np.int32)
        slot[self.buckets] = np.arange(n)
        watched = np.zeros(BUCKETS, bool)
        watched[self.buckets] = watched[self.buckets ^ AGAIN] = True
        row, bucket = term_rows(tk.words(column))
        seen = watched[bucket]
        pair = with_repeats(row[seen] * BUCKETS + bucket[seen])
        feature = slot[pair % BUCKETS]
        known = feature >= 0
        return pair[known] // BUCKETS, feature[known]

    def score(self, column: pa.Array) -> np.ndarray:
        row, feature = self.features(column)
        n = len(column)
        linear = self.bias + np.bincount(row, self.weight[feature], n)
        pairs = np.zeros(n)
        for k in range(self.factors.shape[1]):
            v = self.factors[feature, k]
            pairs += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        return 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -40, 40)))


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, vote: np.ndarray, n_features: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the weighted logistic loss; row ascending."""
    rng = np.random.default_rng(SEED)
    n = len(label)
    prior = float(np.clip((vote @ label + 1) / (vote.sum() + 2), 1e-3, 1 - 1e-3))
    b, w, v = np.log(prior / (1 - prior)), np.zeros(n_features), rng.normal(0, 0.02, (n_features, FACTORS))
    gb, gw, gv = 1e-6, np.full(n_features, 1e-6), np.full((n_features, FACTORS), 1e-6)
    begin = np.searchsorted(row, np.arange(n + 1))
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            length = begin[rows + 1] - begin[rows]
            local = np.repeat(np.arange(len(rows)), length)
            f = feature[np.repeat(begin[rows], length) + np.arange(len(local)) - np.repeat(np.cumsum(length) - length, length)]
            total = np.zeros((len(rows), FACTORS))
            np.add.at(total, local, v[f])
            z = b + np.bincount(local, w[f], len(rows)) + (total**2).sum(1) / 2 - np.bincount(local, (v[f] ** 2).sum(1), len(rows)) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) * vote[rows] / BATCH
            used, where = np.unique(f, return_inverse=True)
            dw = np.bincount(where, error[local], len(used)) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, where, error[local, None] * (total[local] - v[f]))
            dv += DECAY * v[used]
            db = error.sum()
            gb += db * db
            gw[used] += dw * dw
            gv[used] += dv * dv
            rate = RATE * (1 - epoch / EPOCHS)
            b -= rate * db / np.sqrt(gb)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.2 * dv / np.sqrt(gv[used])
    return float(b), w, v


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.sub_batches(batches, "text", 1 << 20):
        w = tk.words(batch.column(1))
        row, bucket = term_rows(w)
        pair = with_repeats(row * BUCKETS + bucket)
        begin = np.searchsorted(pair, np.arange(batch.num_rows + 1) * BUCKETS)
        flat = (pair % BUCKETS).astype(np.int32)
        srow, element = tk.shingles(w)
        first = np.searchsorted(srow, np.arange(batch.num_rows))
        sketch = np.zeros(batch.num_rows, np.uint64)
        some = np.flatnonzero(np.bincount(srow, minlength=batch.num_rows))
        if len(some):
            for k in range(SKETCH):
                order = tk.mix64(element + np.uint64(k << 44))
                sketch[some] = tk.mix64(sketch[some] + np.minimum.reduceat(order, first[some]))
        sketch = sketch.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sketch), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat))], names=["toxic", "sketch", "terms"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits a machine to the labelled rows of ``docs`` that are not held out.

    Labels that are null or not 0 or 1 count as no label; an id labelled twice
    counts once, as toxic if any of its labels says so; of the texts of a
    repeated id the least is learned from.  Without rows of both kinds the
    machine has no terms and scores the prior.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # rows come by the hash of their id, which has nothing to do with label or text
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # an id that names several rows gives one of its texts, the least, so there are TRAIN_ROWS rows at most
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    rows = stage(joined.mapInArrow(_terms, "toxic int, sketch bigint, terms array<int>"), "terms")
    votes = rows.groupBy("sketch", "toxic").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.join(votes, ["sketch", "toxic"]).select("toxic", (1 / F.col("n")).alias("vote"), "terms"), "votes")
    total = rows.agg(F.sum(F.col("vote") * F.col("toxic")).alias("p"), F.sum(F.col("vote") * (1 - F.col("toxic"))).alias("q")).first()
    p, q = total["p"] or 0.0, total["q"] or 0.0
    nothing = Machine(np.zeros(0, np.int64), float(np.log((p + 1) / (q + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    if not p or not q:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            y, vote, flat = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()
            pos += np.bincount(flat, np.repeat(vote * y, lengths), BUCKETS)
            neg += np.bincount(flat, np.repeat(vote * (1 - y), lengths), BUCKETS)
        some = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pos[some]), pa.array(neg[some])], names=["bucket", "a", "b"])

    counts = rows.mapInArrow(count, "bucket bigint, a double, b double").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = p + q
    gap = F.col("a") * (q - F.col("b")) - F.col("b") * (p - F.col("a"))
    chi = n * gap * gap / ((F.col("a") + F.col("b")) * (n - F.col("a") - F.col("b")) * p * q)
    best = counts.where((F.col("a") + F.col("b") >= 2.5) & (F.col("a") + F.col("b") < n)).select("bucket", chi.alias("chi")).where("chi > 4").orderBy(F.desc("chi"), "bucket").limit(TERMS).collect()
    if not best:
        return nothing
    buckets = np.sort(np.array([r["bucket"] for r in best], np.int64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(BUCKETS, -1, np.int32)
        slot[buckets] = np.arange(len(buckets))
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            feature = slot[batch.column(2).flatten().to_numpy()]
            row, feature = row[feature >= 0], feature[feature >= 0]
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([feature[a:b].astype(np.uint16).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["toxic", "vote", "features"])

    sample = rows.mapInArrow(keep, "toxic int, vote double, features binary").collect()  # TRAIN_ROWS rows of TERMS features at most
    sample.sort(key=lambda r: (bytes(r["features"]), r["toxic"], r["vote"]))  # the fit must not depend on how rows were dealt
    features = [np.frombuffer(bytes(r["features"]), np.uint16).astype(np.int64) for r in sample]
    row = np.repeat(np.arange(len(sample)), [len(f) for f in features])
    label, vote = np.array([r["toxic"] for r in sample], float), np.array([r["vote"] for r in sample])
    b, w, v = fit(row, np.concatenate(features), label, vote, len(buckets))
    return Machine(buckets, b, w, v)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The score is a function of the text alone; null counts as empty, and an
    empty text scores what the bias says.  Repeated rows repeat, extra columns
    are ignored, an empty table gives an empty table; a missing id is not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.sub_batches(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; no text is shuffled."""
    @F.arrow_udf(DoubleType())
    def toxic(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [machine.score(part.column(0)) for part in tk.sub_batches(iter([rows]), "text", 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(toxic(F.coalesce("text", F.lit(""))) < THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
