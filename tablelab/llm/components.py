"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablelab.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours of each node, or the node and its smaller ones."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = pairs.join(least, "a")
    if large:
        hung = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root``, the smallest id of its component, of each id in the undirected edges ``a``, ``b``."""
    ids = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    now = materialise(ids.distinct(), "edges")
    while True:
        branching = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        deep = now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")
        if branching.select("a").unionAll(deep).isEmpty():
            break
        now = materialise(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct())
