"""Connected components of links, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (longs ``a``, ``b``) but the roots; a root is the smallest node of its component.

    Each round is written to the shared folder, so a lost executor costs no more than one round. The rounds
    grow with the logarithm of the longest chain. Loops and repeated links don't matter.
    """
    now = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        now = scratch.keep(_small_star(_large_star(now)), "links")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = after
