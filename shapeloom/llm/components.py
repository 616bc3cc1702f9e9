"""Connected components of an edge table, by alternating large and small stars.

Each round is a grouped minimum and a join; the edges are written to the shared folder
after each round, so neither lineage nor driver memory grows. A vertex of very many edges
meets them only in a minimum, which is computed in part before the shuffle, and in a
sort-merge join of stored tables, whose partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.shared import stored, tidy


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (v, root): each vertex of an edge with the least of its component."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges", small=True)
    state = None
    while True:
        # Large star: every larger neighbour of v is linked to the least vertex next to v.
        near = _both(edges)
        least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "component-least", small=True)
        large = near.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "component-large", small=True)
        # Small star: v and its smaller neighbours are linked to the least of them.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "component-low", small=True)
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "component-edges", small=True)
        # Done when each vertex has one edge, to a root: then this sum no longer changes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("v"), "root").unionByName(stars.select(F.col("root").alias("v"), "root").distinct())
