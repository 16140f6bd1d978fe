"""Connected components of an edge table, by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, staged_with


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    return staged_with(edges, "edges", n=F.count(F.lit(1)), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, label): label is the least node that can be reached. Only nodes with edges."""
    now, state = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # written, so that the joins have shuffles of their own, which can split a hub
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before = state
        now, state = _written(small)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
