"""Sequential folds over each key's events: token buckets and activity-anchored flush windows.

Both need a key's events in order. Rows are dealt by key and sorted on disk; a task streams them and holds one state,
so memory is bounded whatever a key's share (time for one key is its own: each decision depends on the one before).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Bucket:
    capacity: int
    rate: float
    tokens: float
    last: int

    def take(self, now: int) -> tuple[bool, int, int | None]:
        """allowed, whole tokens left, seconds to wait if not."""
        self.tokens = min(float(self.capacity), self.tokens + (now - self.last) / 1000.0 * self.rate)
        self.last = now
        if self.tokens >= 1.0:
            self.tokens -= 1.0
            return True, math.floor(self.tokens), None
        return False, 0, max(1, math.ceil((1.0 - self.tokens) / self.rate))


def _sorted(events: DataFrame) -> DataFrame:
    return events.select("key", "seq", "ms").repartition("key").sortWithinPartitions("key", "ms", "seq")


def token_bucket(events: DataFrame, capacity: int = 100, rate: float = 1.67) -> DataFrame:
    """events (key, seq, ms) to (key, seq, ms, allowed, remaining, retry_after, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for batch in batches:
            out = []
            for k, ms in zip(batch.column("key").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                if bucket is None or k != key:
                    key, bucket = k, Bucket(capacity, rate, float(capacity), ms)
                out.append((*bucket.take(ms), bucket.tokens))
            allowed, left, wait, tokens = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(left, pa.int64()), pa.array(wait, pa.int64()), pa.array(tokens, pa.float64())], ["key", "seq", "ms", "allowed", "remaining", "retry_after", "tokens"])

    return _sorted(events).mapInArrow(run, "key long, seq long, ms long, allowed boolean, remaining long, retry_after long, tokens double")


def inactive(buckets: DataFrame, now_ms: int, capacity: int, rate: float) -> DataFrame:
    """The keys whose bucket is full again at now_ms; their state can go."""
    last = buckets.groupBy("key").agg(F.max_by("tokens", F.struct("ms", "seq")).alias("tokens"), F.max("ms").alias("ms"))
    return last.withColumn("evicted", F.least(F.lit(float(capacity)), F.col("tokens") + (now_ms - F.col("ms")) / 1000.0 * rate) >= capacity).select("key", "evicted")


def flush_windows(events: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """events (key, seq, ms) to (key, fire_ms, writes): the first write arms an alarm, which fires every window_ms as
    long as the last window had a write; a fire without writes disarms it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, None
        for batch in batches:
            fires = []
            for k, ms in zip(batch.column("key").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                if anchor is None or k != key or ms >= anchor + 2 * window_ms:
                    key, anchor = k, ms
                elif ms >= anchor + window_ms:
                    anchor += window_ms
                fires.append(anchor + window_ms)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fires, pa.int64())], ["key", "fire_ms"])

    return _sorted(events).mapInArrow(run, "key long, fire_ms long").groupBy("key", "fire_ms").agg(F.count("*").alias("writes"))
