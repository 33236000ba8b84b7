"""Connected components of a graph given by its edges, without a driver-side table and without collecting neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours on to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a, b (longs, a != b). node, root: the smallest node it is connected with, for every node but the roots.

    Alternating large and small stars, each round written to the shared folder; neighbours are only ever counted down to a
    minimum, so a node with very many of them is one skewed join key, which Spark splits. An empty table gives no rows."""
    edges = stored(edges.select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components aren't settled after {rounds} rounds")
