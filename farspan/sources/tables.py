"""Readers and writers: JSON request bodies, Parquet snapshots of an index, result and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT = "id string, vector array<float>, metadata string"
BATCH = f"vectors array<struct<id:string,vector:array<float>,metadata:string>>"
SEARCH = "vector array<float>, k int"
PAIR = "key string, value string"


def parse(bodies: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON bodies (one for each row) to their fields; what doesn't parse gives nulls."""
    return bodies.withColumn("_body", F.from_json(column, schema)).select(*bodies.columns, "_body.*")


def parse_batches(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Batch inserts to one row for each item, with its place in the batch."""
    keep = [c for c in bodies.columns if c != column]
    return bodies.select(*keep, F.posexplode(F.from_json(column, BATCH)["vectors"]).alias("position", "item")).select(*keep, "position", "item.*")


def responses(results: DataFrame) -> DataFrame:
    """(qid, rank, id, distance, score) to one JSON response for each query."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "distance", "score")))
    return results.groupBy("qid").agg(F.to_json(F.struct(F.lit(True).alias("success"), F.count("*").alias("count"), rows.alias("results"))).alias("body"))


def save_snapshot(state: DataFrame, path: str, version: int) -> None:
    """A version of the index state; an earlier version is never touched."""
    state.write.mode("errorifexists").parquet(f"{path}/version={version:010d}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose write has ended."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()[8:]) for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest whole version, or an empty state where there is none. A damaged snapshot is an error, not an empty
    state; a version whose write never ended is passed over."""
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]:010d}") if found else spark.createDataFrame([], schema)


def append_requests(requests: DataFrame, path: str) -> None:
    requests.write.mode("append").parquet(path)
