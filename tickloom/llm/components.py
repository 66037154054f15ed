"""Connected components of a table of links, with all state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.union(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of links (columns a, b: long), component being its least reachable node.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) until each node links straight to its root; rounds grow with
    the logarithm of the longest path. A frequent node's links meet its least neighbour in a
    join that can be split, after a minimum that is combined before it is shuffled.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    digest = None
    for _ in range(most_rounds):
        before, edges = edges, written(_small_star(_large_star(edges)), "stars")
        removed(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
