"""Vector and key-value state out of mutation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, by a partial maximum (no window, so a hot key costs a row for each task)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(key, "_row.*")


def kv_state(log: DataFrame) -> DataFrame:
    """log (seq, op put/delete, key, value) to the keys that are there."""
    return latest(log, "key", "seq").where("op = 'put'").select("key", "value")


def apply_flags(state: DataFrame, requests: DataFrame, deleted: bool) -> DataFrame:
    """Soft deletion (or its undoing): requests (id) against state (id, deleted) to (id, outcome)."""
    done, before = ("deleted", "already_deleted") if deleted else ("restored", "not_deleted")
    own = state.select(F.col("id"), F.col("deleted"))
    return requests.select("id").distinct().join(own, "id", "left").select("id", F.when(F.col("deleted").isNull(), "not_found").when(F.col("deleted") != F.lit(deleted), done).otherwise(before).alias("outcome"))


def get(state: DataFrame, id_) -> DataFrame:
    return state.where((F.col("id") == id_) & ~F.col("deleted"))


def contains(state: DataFrame, ids: DataFrame) -> DataFrame:
    there = state.where(~F.col("deleted")).select("id", F.lit(True).alias("found"))
    return ids.join(there, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def compact(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deleted"))


def stats(state: DataFrame) -> DataFrame:
    """state (id, vector, deleted): counts, dimension, percentage deleted."""
    out = state.agg(F.count("*").alias("num_vectors"), F.count_if(~F.col("deleted")).alias("num_active"), F.count_if(F.col("deleted")).alias("num_deleted"), F.max(F.size("vector")).alias("dimension"))
    return out.withColumn("deleted_percent", F.when(F.col("num_vectors") > 0, F.col("num_deleted") * 100.0 / F.col("num_vectors")).otherwise(0.0))
