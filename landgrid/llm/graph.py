"""Distributed union-find: connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.store import keep


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hang(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is the least node within reach.

    Large-star and small-star steps in turn, each one aggregation and one join that Spark can split on a
    hot node; the number of rounds grows with the logarithm of the longest path. Nulls and loops join
    nothing; an empty table gives an empty one.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = keep(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        hung = _hang(down)
        small = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            hung.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = keep(small, "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component")))
