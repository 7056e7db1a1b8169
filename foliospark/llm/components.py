"""Connected components by alternating stars; every round is an aggregation and a join, cut by a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of the edges a, b.

    Large star: a node's larger neighbours move to its smallest one. Small star: a node and its smaller neighbours move to
    the smallest of them. Rounds end when nothing moves: every edge then leads from a node to its component.
    Self-links and repeated edges are allowed; an edge with a null end is ignored. No edges: an empty result.
    """
    now = stored(_down(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")), "edges")
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        # small star: of a node's smaller neighbours all, and the node, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(_down(small.select("e.*").where("a <> b")), "edges")
        moved = after.exceptAll(now) if after.count() == now.count() else None
        now = after
        if moved is not None and moved.isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
