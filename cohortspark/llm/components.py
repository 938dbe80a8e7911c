"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (both.groupBy("a").agg(F.min("b").alias("m"))
             .select("a", F.least("a", "m").alias("m")))
    return (both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (moved.filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"),
                                                         F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b"))).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, which points to none."""
    again = edges.groupBy("a").count().filter("count > 1").select("a")
    inner = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a",
                                    "left_semi")
    return again.unionAll(inner).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table with columns a and b.

    The root is the component's smallest node.  Node values are longs; loops
    and repeated edges are ignored, an empty table gives no rows, null ends
    are dropped.  Minima are combined before each shuffle, and the joins with
    them have one row per node on one side, so Spark can split a hot node.
    Each round is checkpointed; the driver learns whether another is needed.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                    F.least("a", "b").alias("b")).distinct())

    while not _are_stars(now):
        now = cut_lineage(_small_star(_large_star(now)))
    # each star is a component, and its centre the smallest node
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
