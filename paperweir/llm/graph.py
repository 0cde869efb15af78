"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its (larger, or smaller) neighbours the smallest node that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    own = least.where("a <> least").select("a", F.col("least").alias("b"))
    return linked.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a and b of one orderable type); root is the smallest node reached.

    Edges with a null end and loops count for nothing.  Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        after = stored(_star(_star(now, True), False), "edges")
        mark = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        now = after
        if mark == before:
            break
        before = mark
    child = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return child.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
