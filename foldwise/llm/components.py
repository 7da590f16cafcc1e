"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import keep


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), no nulls -> (node, root): for every node that has
    an edge to another, the smallest node that it reaches.

    A round links each node's larger neighbours to its smallest neighbour, then each
    node's smaller neighbours to the smallest of them, until the edges are stars.
    Rounds grow with the logarithm of the number of nodes.  Every step is a grouped
    minimum, taken before the shuffle, and a join of the edges to it, one row a node
    on that side, so a node with very many edges is split by the skew join.  Each
    round's edges are written to the checkpoint folder.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
