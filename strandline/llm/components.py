"""Connected components of a link table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Rounds after which something other than a long chain must be wrong; each round at least halves what is left.
MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reached.

    Every round takes the smallest label among a node's neighbours, hands it to
    the whole tree the node is in, and then follows labels one step further.
    Labels live in a staged table, so a lost executor costs no more than the
    running round.  Self-links are harmless and an empty table gives no rows.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("c")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("c").alias("m"))
        met = label.join(near, label["node"] == near["a"], "left").select("node", "c", F.least("c", F.coalesce("m", "c")).alias("best"))
        met = stage(met, "met")
        # only trees that change, staged: a join with an aggregate of the same key could not split a large tree
        root = stage(met.groupBy("c").agg(F.min("best").alias("r")).where("r < c"), "roots")
        moved = met.join(root, "c", "left").select("node", "c", F.coalesce("r", "c").alias("r"))
        step = label.select(F.col("node").alias("r"), F.col("c").alias("next"))
        after = moved.join(step, "r", "left").select("node", F.col("c").alias("was"), F.least("r", F.coalesce("next", "r")).alias("c"))
        after = stage(after, "labels")
        label = after.select("node", "c")
        if after.where("was <> c").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return label.select("node", F.col("c").alias("component"))
