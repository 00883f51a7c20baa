"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.session import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates two star steps until nothing changes: every neighbour above a node, and then
    every neighbour below it, is tied to the smallest node around. Edges stay at most as many
    as at the start, each step is a grouped minimum (combined map-side) and a join whose hot
    side Spark can split, and rounds grow with the logarithm of the longest chain. Each round
    is a stored table. No edges give an empty table.
    """
    current = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = _shape(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        large = materialize(
            both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct(), "star-large")
        # now every row leads from a node to a smaller one
        least_below = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "star-below")
        small = large.join(least_below, "a")
        after = materialize(
            small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least_below.select("a", F.col("m").alias("b"))).distinct(), "star-small")
        shape = _shape(after)
        for stored in (current, least, large, least_below):
            discard(stored)
        current = after
        if shape == before:
            break
        before = shape
    members = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _shape(edges: DataFrame) -> tuple:
    """Row count and a checksum: equal when a round changed nothing."""
    mixed = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mixed, F.count_distinct("b")).first())
