"""Connected components of any size by alternating stars; nothing but sums comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.session import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    linked = both.join(least, "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges point down (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node reachable from every node that has a link.

    Links may repeat, point either way or join a node with itself. Each round is two aggregates of minima (combined before
    the shuffle) and two joins; it is written to the shared folder, so a lost executor costs no earlier round. The number of
    rounds grows with the logarithm of the longest chain.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = store(down, "links")
    mark = None
    while True:
        n, total = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
        state = store(_small_star(_large_star(state)), "links")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
