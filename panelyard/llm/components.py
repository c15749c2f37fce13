"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a BIGINT, b BIGINT); the smallest node names it.

    Large-star and small-star in turn: every node sends its neighbours to the smallest one it
    knows. Rounds grow with the logarithm of the longest path. A hub's neighbours are rows of
    joins that Spark may split, never one list. Self-links and nulls count for nothing; each
    round is written to the shared folder.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a > b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Small: the smaller neighbours of u go to the smallest. Large: the larger ones do."""
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not small:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        # A table of its own, so that the join can split the neighbours of a hub.
        least = stage(least.select("u", F.least("u", "low").alias("low")), "least")
        moved = both.join(least, "u")
        if small:
            out = moved.select(F.col("v").alias("a"), F.col("low").alias("b"))
            out = out.union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
        else:
            out = moved.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        return out.where("a > b").distinct()

    def same(x: DataFrame, y: DataFrame) -> bool:
        total = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        return x.agg(*total).first() == y.agg(*total).first()

    while True:
        after = stage(star(star(edges, False), True), "links")
        done = same(edges, after)
        edges = after
        if done:
            break
    # A forest of stars is left: every larger node has one edge, to the smallest of its component.
    return nodes.join(edges.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component"))
