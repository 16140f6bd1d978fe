"""Structured Streaming forms: token buckets and flush alarms with keyed state, batched writes, windowed metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Bucket


def token_bucket(events: DataFrame, capacity: int = 100, rate: float = 1.67) -> DataFrame:
    """A stream of (key, seq, ms) to decisions. A bucket goes only when it is full again, which a new one is too."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(parts)).sort_values(["ms", "seq"])  # one micro-batch of one key
        bucket = Bucket(capacity, rate, tokens, int(rows["ms"].iloc[0]) if last is None else last)
        out = [(key[0], s, m, *bucket.take(int(m))) for s, m in zip(rows["seq"], rows["ms"], strict=True)]
        state.update((bucket.tokens, bucket.last))
        state.setTimeoutDuration(max(1, math.ceil((capacity - bucket.tokens) / rate * 1000)))
        frame = pd.DataFrame(out, columns=["key", "seq", "ms", "allowed", "remaining", "retry_after"])
        yield frame.astype({"retry_after": "Int64"})

    return events.groupBy("key").applyInPandasWithState(run, "key long, seq long, ms long, allowed boolean, remaining long, retry_after long", "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def batched_writes(log: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """Mutations gathered and written as one Parquet batch each trigger."""
    return log.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start()


def request_metrics(requests: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests (ts, status, duration_ms) to counts, error counts and mean latency of each window."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.avg("duration_ms").alias("avg_ms"))
