"""Aggregates over request events (path, ms, status, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(requests: DataFrame, *by: str) -> DataFrame:
    return requests.groupBy(*by).agg(F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), F.percentile("ms", 0.99).alias("p99"))


def index_percentiles(requests: DataFrame, by: str, whole: list[int] = (50, 95, 99)) -> DataFrame:
    """The element at n * p div 100 (from 0) of each group's sorted values. Equal values are counted first, so the
    window runs over distinct values and no group is gathered."""
    counts = requests.groupBy(by, "ms").agg(F.count("*").alias("c"))
    order = Window.partitionBy(by).orderBy("ms")
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return upto.groupBy(by).agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("ms"))).alias(f"p{p}") for p in whole))


def error_rate(requests: DataFrame, *by: str) -> DataFrame:
    out = requests.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") >= 500).alias("failed"))
    return out.withColumn("error_percent", F.floor(F.col("failed") * 100 / F.col("total")).cast("long"))


def throughput(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of each window of that many seconds."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return requests.groupBy(start.alias("start_s")).agg(F.count("*").alias("n")).withColumn("per_second", F.col("n") / seconds)
