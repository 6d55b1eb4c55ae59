"""Connected components of a graph given as edges, by alternating large and small stars:
each round links every node's neighbours to the smallest one, until all groups are stars.
The number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.registry import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("x > y")
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    own = least.select("x", F.col("m").alias("y"))
    others = down.join(least, "x").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return own.union(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Per node with an edge: node, label (the smallest node of its component). Edges have
    columns x and y; loops and repeated edges do no harm; no edges, no rows."""
    now = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    size = _mark(now)
    while size[0]:
        now = cut(_small_star(_large_star(now)))
        new = _mark(now)
        if new == size:
            break
        size = new
    return now.select(F.col("x").alias("node"), F.col("y").alias("label")).union(now.select("y", "y")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    h = F.xxhash64("x", "y").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0)).cast("string")).first())
