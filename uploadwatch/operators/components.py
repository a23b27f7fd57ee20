"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uploadwatch.scratch import materialize


def _down(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of edges (a, b).

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = materialize(_down(edges), "edges")
    while True:
        heads = edges.groupBy("a").agg(F.count("*").alias("n"))
        below = edges.join(heads.select(F.col("a").alias("b")), "b", "left_semi")
        if below.isEmpty() and heads.filter("n > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = _down(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        edges = materialize(_down(small), "edges")
