"""State behind the service's verbs: upserts, batches, configuration, key-value reads, filters, collections."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import normalize
from ..functions.requests import level_of
from .store import latest


def upsert(log: DataFrame, dimension: int, metric: str = "cosine") -> DataFrame:
    """log (seq, id, vector, metadata) to the accepted state (id, vector, metadata, level, deleted), the last write of
    each id: vectors of another dimension are turned away, cosine vectors normalised, levels drawn."""
    fit = log.where(F.size("vector") == dimension)
    own = normalize(F.col("vector")) if metric == "cosine" else F.transform("vector", lambda x: x.cast("double"))
    return latest(fit.select("id", "seq", "vector", "metadata"), "id", "seq").select("id", own.alias("vector"), "metadata", level_of(F.col("id")).alias("level"), F.lit(False).alias("deleted"))


def batch_outcome(items: DataFrame, dimension: int) -> DataFrame:
    """items (batch, position, id, vector) to (batch, total, inserted, failed, success, distinct_ids): a bad item fails
    alone; within a batch later items of an id replace earlier ones."""
    ok = F.size("vector") == dimension
    out = items.groupBy("batch").agg(F.count("*").alias("total"), F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("failed"), F.count_distinct(F.when(ok, F.col("id"))).alias("distinct_ids"))
    return out.withColumn("success", F.col("failed") == 0)


def configured(spark: SparkSession, dimension: int, metric: str = "cosine", m: int = 16, ef_construction: int = 200, ef_search: int = 100) -> DataFrame:
    """The one row of a new configuration; with it the index is empty."""
    if m < 2:
        raise ValueError("m must be 2 or more")
    row = (dimension, metric, m, 2 * m, ef_construction, ef_search, 1 / math.log(m), 0)
    return spark.createDataFrame([row], "dimension int, metric string, m int, m0 int, ef_construction int, ef_search int, level_factor double, num_vectors long")


def kv_get(keys: DataFrame, cached: DataFrame, stored: DataFrame) -> DataFrame:
    """keys (key) against cached and stored pairs (key, value) to (key, value, source): the cache first; source null
    where neither has the key."""
    own = keys.join(cached.select("key", F.col("value").alias("near")), "key", "left").join(stored.select("key", F.col("value").alias("far")), "key", "left")
    return own.select("key", F.coalesce("near", "far").alias("value"), F.when(F.col("near").isNotNull(), "cache").when(F.col("far").isNotNull(), "storage").alias("source"))


def write_through(cached: DataFrame, stored: DataFrame, puts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """puts (key, value), one for each key, reach both cache and store."""
    return tuple(side.join(puts, "key", "left_anti").select("key", "value").unionByName(puts.select("key", "value")) for side in (cached, stored))


COMPARISONS = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def metadata_filter(filters: str, metadata: Column) -> Column:
    """A filter like {"price": {"lt": 100, "gte": 5}, "user": "x"} over a JSON column, all of it to hold. A field that
    is missing holds nothing. Numbers compare as numbers, all else as text."""
    out = F.lit(True)
    for field, rule in json.loads(filters).items():
        for name, value in (rule if isinstance(rule, dict) else {"eq": rule}).items():
            if name not in COMPARISONS:
                raise ValueError(f"unknown comparison: {name}")
            own = F.get_json_object(metadata, "$['" + field.replace("'", "") + "']")
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            told = COMPARISONS[name](own.try_cast("double"), F.lit(float(value))) if number else COMPARISONS[name](own, F.lit(str(value).lower() if isinstance(value, bool) else value))
            out = out & F.coalesce(told, F.lit(False))
    return out


def best_of_collections(results: DataFrame, k: int) -> DataFrame:
    """results (collection, qid, id, distance) to the k best of each query and collection."""
    rank = F.row_number().over(Window.partitionBy("collection", "qid").orderBy("distance", "id")).cast("long")
    return results.withColumn("rank", rank).where(F.col("rank") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) as a set that holds each edge both ways."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
