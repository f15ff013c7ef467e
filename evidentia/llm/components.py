"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is a map-side combined minimum and an equi-join; no adjacency list, component or edge
set is gathered in one task or on the driver. Each round is cut by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with a > b. Large star: links each larger neighbour of a node to the node's minimum.
    Small star: links the smaller neighbours of a node, and the node, to their minimum."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("c")).join(low, "a").select(F.col("c").alias("a"), F.col("m").alias("b"))
        own = low.filter("a > m").select("a", F.col("m").alias("b"))
        out = out.union(own)
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long), undirected -> (id long, component long) for every id on an edge between two
    different ids; component is the smallest id reachable. Self-loops and repeated edges are ignored, null
    ends too. Raises if the bound on rounds is met (they grow with the logarithm of the path length)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        after = written(_star(_star(now, large=True), large=False), "edges")
        # a fixed point: every larger end has one edge, and no end is both larger and smaller
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop_written(now)
        now = after
        if seen == (sign["n"], sign["s"]):
            return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = (sign["n"], sign["s"])
    raise RuntimeError("connected components did not settle")
