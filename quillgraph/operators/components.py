"""Weakly connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.staging import staged


def connected_components(ids: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``ids(id)``, ``edges(a, b)`` -> ``(id, component)``, the smallest id reachable; isolated ids are their own.

    Each round hangs every node's larger neighbours on its smallest one, then every node with its smaller
    neighbours on the smallest. Rounds grow with the logarithm of the longest path. Hubs are aggregated before
    they are shuffled.
    """
    tree = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most_rounds):
        both = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        lower = hung.join(least, "a")
        tree = staged(lower.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return ids.join(tree.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
