"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node with the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours with the smallest of them; ``a < b`` in each row."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    joined = edges.join(least, "b")
    others = joined.where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("least").alias("a"), "b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number of rows and sums over their hashes: equal for equal tables."""
    sums = [F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``doc_id, component`` (smallest id reached) of all nodes in ``links`` (columns ``a, b``).

    Alternating star steps: every step keeps the components and needs as many rows as there are
    links at most; the number of rounds is about the logarithm of the longest path. Each round
    is written to the shared folder, which cuts the lineage.
    """
    edges = save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = _digest(edges)
    while True:
        edges = save(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct())
