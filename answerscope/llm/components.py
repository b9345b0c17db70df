"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps.

Every step is a partial minimum for each node and a join back to the edges; a node with very many edges is combined
before it is shuffled and its edges are split by the skew join. Each round is stored in the shared folder, so a lost
executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), both of one ordered type -> (node, root) for every node of an edge; root is the least node.

    Rounds go on until one changes nothing: its edges, as many as before and all different, are all among those. (Counts and
    sums of hashes only tell when to look.) Each moves edges to lesser nodes, so there is a last one; their number grows
    with the logarithm of the longest path, squared at most.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        after = _mark(edges)
        if after == before and edges.join(last, ["a", "b"], "left_anti").isEmpty():
            break
        before = after
    # at the fixed point every edge leads from a node to its component's least one
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
