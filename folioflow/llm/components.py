"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, stash, unstash

MAX_ROUNDS = 60


def _lowest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v), and per u the smallest of u and its v with the number of pairs."""
    return pairs, pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count(F.lit(1)).alias("deg"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), where root is the smallest node of its component.

    Nodes are non-null and orderable. Each round's edges are written to the shared folder. Joins go
    through join_classes, so a node with a large share of all edges does not meet in one task.
    Nodes without an edge to another node are left out; an empty input gives no rows.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stash(e, "cc"), None
    for _ in range(MAX_ROUNDS):
        n = e.count()
        if not n:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs, low = _lowest(both)
        low = stash(low, "cc-low")
        large = join_classes(pairs, low, ["u"], "deg", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        large = stash(large, "cc-large")
        unstash(low)
        n = large.count()
        pairs, low = _lowest(large)
        low = stash(low, "cc-low")
        small = join_classes(pairs, low, ["u"], "deg", n).select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(low.select("u", F.col("low").alias("v"))).filter("u != v").distinct()
        small = stash(small, "cc")
        unstash(low, large, e)
        e = small
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge leads from a node to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
