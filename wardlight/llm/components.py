"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.session import checkpointed


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Every node sends its neighbours (small: the smaller ones and itself; large: the
    larger ones) to the smallest of all."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    sent = both.join(least, "u")
    if small:
        out = sent.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = sent.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge and another root: the smallest node that it
    reaches.  edges: a, b.  Each round is checkpointed; rounds grow with the logarithm of
    the longest path."""
    spark = edges.sparkSession
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = checkpointed(spark, turned), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] == 0 or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        now = checkpointed(spark, _stars(_stars(now, small=False), small=True))
