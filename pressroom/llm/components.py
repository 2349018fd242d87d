"""Connected components by alternating large and small stars: a node is tied to the least node it can reach.

A star's hub is a hot key: a large family's rows all have it. So the least neighbour of each node is aggregated first (combined
before the shuffle, one row a node) and written; the edges then meet it by broadcast while it has few rows, and beyond that by a
join of two tables as they lie, of which Spark splits what is skewed. Null nodes have no edges. Repeated edges and edges from a node to
itself change nothing; without edges the result is empty. Nodes may have any type that can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, small_or_same


def _large(e: DataFrame, old: list[str]) -> DataFrame:
    """Every greater neighbour of a node to the least of its neighbours and itself."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), old)
    return both.where("v > u").join(small_or_same(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, old: list[str]) -> DataFrame:
    """Every lesser neighbour of a node, and the node, to the least of them. e: v < u."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), old)
    tied = e.join(small_or_same(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, root for every node that has an edge to another; root is the least node of the component.

    Each half round is written to the shared folder, and what it was made from deleted; it ends when a round changes nothing
    (O(log^2) rounds)."""
    spark, old, last = edges.sparkSession, [], []
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialize(e, last), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        old, last, before = last, [], now
        stars = materialize(_large(e, old), old)
        e = materialize(_small(stars, old), last)
        remove(spark, old)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
