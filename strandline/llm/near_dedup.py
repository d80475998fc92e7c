"""Near duplicates by weighted MinHash (DartMinHash), banding and exact verification.

1. One pass over the texts: five-word shingles with their counts become a
   DartMinHash signature (textkit.dart_signatures), its band hashes and a
   fingerprint of the word sequence.
2. Texts with the same words fold into one node, named by its fingerprint, so
   copies never meet in a bucket.
3. Nodes that share a band are candidates.  A bucket of up to SMALL_BUCKET
   nodes gives all its pairs.  A larger one has a hub, its most central node,
   and gives the pairs with the hub; so rows are linear in the number of nodes.
4. Pairs whose numbers of shingles alone keep them below the threshold go; this
   bound is exact.  Every node's best candidate and all pairs with hubs are
   verified on the full shingle multisets, then every candidate that still
   joins two classes.
   Members of a large bucket that are not in their hub's class may be alike to
   other members: _leftovers finds these by bounds that are exact.
5. Classes are the connected components of the verified links.

Keys that hold many rows (a bucket, a hub, a class) are never gathered: sizes,
hubs and roots are staged as one row for each key and joined back, so that a
skewed side of such a join can be split.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .staging import quoted, small, stage, table, unused

N_WORDS, THRESHOLD = 5, 0.8
BANDS, WIDTH = 24, 4
#: A pair at 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
COORDINATES = BANDS * WIDTH
SMALL_BUCKET = 16
#: Words of 64 bits in the sets of what a member misses and of what it adds.
SET_WORDS = 8
_SIGNATURE = "doc_id bigint, node bigint, n bigint, bands array<bigint>"


def _name(w: tk.Words) -> np.ndarray:
    """The node of each text: a fingerprint of its words."""
    return tk.sequence_hash(w.hash, w.first, 1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.sub_batches(batches, "text", 1 << 20):
        texts = tk.clean(batch.column(1))
        w = tk.words(texts)
        row, element = tk.shingles(w, N_WORDS)
        token = tk.occurrences(row, element)
        sig, has = tk.dart_signatures(row, token, batch.num_rows, COORDINATES)
        bands = tk.band_hashes(sig, BANDS, WIDTH)
        node = _name(w)
        for i in np.flatnonzero(~has):  # no words: only equal texts are alike
            node[i] = np.frombuffer(hashlib.sha256(texts[int(i)].as_py().encode()).digest()[:8], np.int64)[0]
        n = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(n), lists], names=["doc_id", "node", "n", "bands"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tokens) of every text with words; of copies in a slice one stays."""
    for batch in tk.sub_batches(batches, "text", 1 << 20):
        w = tk.words(batch.column(1))
        node, first = np.unique(_name(w), return_index=True)
        busy = w.counts()[first] > 0
        row, element = tk.shingles(w, N_WORDS)
        token = tk.occurrences(row, element).view(np.int64)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token))
        if busy.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[busy]), lists.take(pa.array(first[busy]))], names=["node", "tokens"])


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs a < b of the buckets' nodes with the number of buckets they share."""
    lists = buckets.groupBy("bucket").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("all"))
    first = lists.select("all", F.posexplode("all").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    near = F.least("a.n", "b.n") >= F.lit(THRESHOLD - 1e-9) * F.greatest("a.n", "b.n")  # alike texts have alike sizes
    return pairs.where(near).groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count(F.lit(1)).alias("agree"))


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, agree) of small buckets, and distinct (node, hub) of large ones."""
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # staged apart, for a join with an aggregate of the same key could not split a large bucket
    size = stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    met = stage(banded.join(size, "bucket"), "buckets")
    large = met.where(F.col("m") > SMALL_BUCKET)
    central = large.groupBy("node").agg(F.sum("m").alias("central"))
    hub = large.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"))
    star = large.join(stage(hub, "hubs"), "bucket").where("node <> hub").select("node", "hub").distinct()
    return _all_pairs(met.where(F.col("m") <= SMALL_BUCKET)), stage(star, "stars")


def _measured_stars(star: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each member: its size, what it shares with its hub, and bit sets of what it misses and adds."""
    own = tokens.select("node", F.col("tokens").alias("ta"))
    center = tokens.select(F.col("node").alias("hub"), F.col("tokens").alias("tb"))
    both = star.join(own, "node").join(center, "hub").select("node", "hub", "ta", "tb", F.array_except("tb", "ta").alias("missed"), F.array_except("ta", "tb").alias("added"))
    n, h, more = F.size("ta"), F.size("tb"), F.size("added")
    bits = [_bits(side, k).alias(f"{side[0]}{k}") for side in ("missed", "added") for k in range(SET_WORDS)]
    sets = both.select("node", "hub", n.alias("n"), h.alias("h"), more.alias("more"), ((n - more) / (h + more)).alias("similarity"), *bits)
    return sets.withColumn("excess", F.col("more") - _count(F.col(f"a{k}") for k in range(SET_WORDS)))


def _bits(side: str, word: int) -> Column:
    """One word of the bit set of an array of hashes."""
    mine = F.filter(side, lambda t: F.pmod(F.shiftright(t, 6), F.lit(SET_WORDS)) == word)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(t, F.lit(64)).cast("int"))))


def _count(words: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(w) for w in words))


def _leftovers(measured: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of members of one hub that may be alike although one is not in the hub's class.

    Alike texts differ in size by a factor of 1 / threshold at most, and, as one
    less the similarity is a metric, in similarity to the hub by 1 - threshold
    at most.  So members meet only within neighbouring cells of size and
    similarity.  There a bound decides that is exact as well: what two members
    share is at most the hub's shingles that neither misses, and of what the hub
    lacks the bits that both have, the smaller number of those on a taken bit,
    and what either adds.
    """
    placed = measured.join(label.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    placed = placed.join(label.select(F.col("node").alias("hub"), F.col("component").alias("hc")), "hub", "left").withColumn("hc", F.coalesce("hc", "hub"))
    far = F.floor((1 - F.col("similarity")) / (1 - THRESHOLD + 1e-6))
    long = F.floor(F.log(F.col("n").cast("double")) / (1e-6 - math.log(THRESHOLD)))
    placed = stage(placed.withColumn("far", far).withColumn("long", long), "placed")
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    x = placed.where("c <> hc").withColumn("far", near("far")).withColumn("long", near("long")).alias("x")
    y = placed.alias("y")
    missed = _count(F.col(f"x.m{k}").bitwiseOR(F.col(f"y.m{k}")) for k in range(SET_WORDS))
    added = _count(F.col(f"x.a{k}").bitwiseAND(F.col(f"y.a{k}")) for k in range(SET_WORDS)) + F.least("x.excess", "y.excess")
    shared = F.col("x.h") - missed + F.least(added, F.col("x.more"), F.col("y.more"))
    # alike means shared / (n + n' - shared) >= threshold
    enough = F.least(shared, F.col("x.n"), F.col("y.n")) * (1 + THRESHOLD) + 1e-6 >= THRESHOLD * (F.col("x.n") + F.col("y.n"))
    cell = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.far") == F.col("y.far")) & (F.col("x.long") == F.col("y.long"))
    pairs = x.join(y, cell & (F.col("x.c") != F.col("y.c")) & enough)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs whose multisets of shingles reach the threshold, with the exact similarity."""
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    measured = both.select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("similarity"))
    return measured.where(F.col("similarity") >= THRESHOLD)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, group_size, kept.

    Texts are alike if the weighted Jaccard similarity of their five-word
    shingles, counted with repeats, is 0.8 or more; classes are what links of
    alike texts connect.  class_id is the smallest doc_id of the class and the
    one that is kept.  A text of one to four words has one shingle.  Texts
    without words, null and empty ones among them (null counts as empty), are
    alike only if equal.  Rows without an id link texts like any other, and so
    does each text of an id that names several; a class without any id has a
    class_id made from a fingerprint.  Texts are told apart by fingerprints of 64 bits, two of n
    texts have the same one with probability n * n / 2**65.  Repeated rows
    repeat, extra columns are ignored, an empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = stage(source.mapInArrow(_sign, _SIGNATURE), "signatures")
    nodes = stage(signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    pairs, star = _candidates(nodes.where("n > 0").select("node", "n", "bands"))
    likely = stage(pairs, "candidates")

    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(star.select("node")).union(star.select("hub")).distinct()
    wanted = stage(nodes.select("node", "least_id").join(wanted, "node", "left_semi"), "wanted")
    ids = small(wanted.where("least_id is not null").select(F.col("least_id").alias("doc_id")).distinct())  # above its bound a shuffle join finds the texts
    # no task of the union runs two Python workers at once
    texts = source.join(ids, "doc_id", "left_semi").union(source.where("doc_id is null"))
    found = texts.mapInArrow(_tokens, "node bigint, tokens array<bigint>")
    # an id may name other texts too, and texts without an id are all read
    tokens = stage(found.join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "tokens")

    sides = likely.select(F.col("a").alias("node"), F.col("b").alias("other"), "agree").union(likely.select(F.col("b"), F.col("a"), "agree"))
    best = sides.groupBy("node").agg(F.max(F.struct("agree", "other")).alias("best")).select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()
    measured = stage(_measured_stars(star, tokens), "members")
    starred = measured.where(F.col("similarity") >= THRESHOLD).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    label = components(_verified(best, tokens).select("a", "b").union(starred))
    rest = likely.select("a", "b").join(best, ["a", "b"], "left_anti").union(_leftovers(measured, label)).distinct()
    rest = rest.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    rest = stage(rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb"), "rest")
    more = _verified(rest, tokens).join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = components(more)

    top = nodes.select("node", "least_id", "copies").join(label, "node", "left").withColumn("c1", F.coalesce("component", "node")).drop("component")
    top = stage(top.join(second.withColumnRenamed("node", "c1"), "c1", "left").select("node", F.coalesce("component", "c1").alias("class"), "least_id", "copies"), "placed")
    # a fingerprint may be less than any id: the class is named by its ids as long as it has one
    sizes = stage(top.groupBy("class").agg(F.sum("copies").alias("group_size"), F.coalesce(F.min("least_id"), "class").alias("class_id")), "sizes")
    answer = stage(top.join(sizes, "class").select("node", "class_id", "group_size"), "classes")
    return signed.select("doc_id", "node").join(answer, "node").select("doc_id", "class_id", "group_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    A class without any id keeps the rows it has, and so does an id of which any
    row stays.
    """
    names, key = docs.columns, unused("gone", docs)
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col).where("doc_id is not null")
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(key))
    gone = small(stage(gone, "gone"))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti").select(*map(quoted, names))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
