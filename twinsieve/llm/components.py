"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is one node of the component.

    In every round each node points to the first of its neighbours and itself, and the links move to those. The order
    is drawn anew from a hash of the round and the node, so no numbering of the nodes makes a bad case: a node
    remains only if it comes first around itself or around one of its neighbours, which on a path half of the nodes
    do on average, and a pair or a group linked all to all is done in one round. Rounds grow with the logarithm of
    the longest path. A hub's links meet only in sums with map-side combine; joins on a hub are left sides that Spark
    can split. Every round is written to the shared folder; nothing but a row count reaches the driver. Links of a
    node to itself and repeated links change nothing; without links the result is empty.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, turn = None, 0
    while not links.isEmpty():
        placed = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("place"), c.alias("node"))
        first: Column = F.least(placed(F.col("a")), F.min(placed(F.col("b"))))
        to = stored(both(links).groupBy("a").agg(first.alias("to")).select("a", F.col("to.node").alias("to")), "links-to")
        moved = to.select(F.col("a").alias("root"), "to")
        if roots is None:
            roots = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = links.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = stored(ends.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        turn += 1
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
