"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node
    of the component. Each round is a written table, so a lost executor costs
    that round only; rounds grow with the logarithm of the longest chain."""
    edges = C.stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a != b").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = C.stage(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
