"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._base import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), each link once. Every node's neighbours are re-linked to the least node among them and it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that it reaches.

    Each round is two aggregations by node and two joins; a hub's links are split by skew-join handling, and only a
    count and a checksum reach the driver. Rounds grow with the logarithm of the longest chain.
    """
    edges, seen = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(max_rounds):
        n, mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if n == 0 or seen == (n, mark):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (n, mark)
        edges = cut(_star(_star(edges, large=True), large=False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
