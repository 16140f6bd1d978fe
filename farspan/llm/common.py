"""Helpers shared by the corpus operators: tables, staging, and Bloom filters of a bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Hash rows for one segment of the paired filters; the number of segments grows with the rows.
SEGMENT_ROWS = 1 << 17
#: The largest filter that is ever broadcast, in bits (32 MiB).
MAX_FILTER_BITS = 1 << 28
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # fixed odd multipliers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough that very long texts don't fill a worker, or the buffers between it and the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def lean(run: Callable) -> Callable:
    """run (batches to batches) in a worker that gives its free memory back to the system when a task is done: workers
    are used again for other work, and what they only might need again adds up over an executor."""

    @wraps(run)
    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session that names none gets a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or (lambda d: d.get() if d.isDefined() else None)(sc._jsc.sc().getCheckpointDir())
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="farspan-")
        sc.setCheckpointDir(root)
    return root


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: no lineage, and it outlives executors."""
    path = f"{staging_root(df.sparkSession)}/farspan/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """df as `staged` has it, and aggregates of it that are taken while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, *(c.alias(k) for k, c in measures.items())), label)
    return out, seen.get


def shared_with(spark: SparkSession, value) -> Broadcast:
    """value on all executors, until `release`. Its size must be bounded."""
    return spark.sparkContext.broadcast(value)


def release(*shared: Broadcast) -> None:
    """Frees broadcast values that only written tables have been made with."""
    for x in shared:
        x.destroy()


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(x, 1)))))


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each 64-bit hash in a filter of a power of two bits."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [((h ^ (h >> np.uint64(29))) * np.uint64(m)) >> shift if bits > 1 else np.zeros(len(h), np.uint64) for m in ODD]


class SegmentedFilter:
    """A Bloom filter in segments chosen by the low bits of the hash, as tasks built them and the driver joined them."""

    def __init__(self, bits: np.ndarray, segments: int, segment_bits: int):
        self.bits, self.segments, self.segment_bits = bits, segments, segment_bits

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        base = (h & np.uint64(self.segments - 1)) * np.uint64(self.segment_bits)
        hit = np.ones(len(h), bool)
        for p in positions(h, self.segment_bits):
            at = base + p
            hit &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit


def _gather(spark: SparkSession, rows: DataFrame, segments: int, segment_bits: int) -> SegmentedFilter:
    """rows (seg, bits): at most MAX_FILTER_BITS in all."""
    bits = np.zeros(max(1, segments * segment_bits // 8), np.uint8)
    n = segment_bits // 8
    for seg, part in rows.collect():
        bits[seg * n : (seg + 1) * n] |= np.frombuffer(part, np.uint8)
    return SegmentedFilter(bits, segments, segment_bits)


def _layout(n: int, most: int) -> tuple[int, int]:
    segments = min(max(64, power_of_two(n / SEGMENT_ROWS)), 1 << 21)
    return segments, max(64, min(power_of_two(12 * max(n, 1) / segments), most // segments))


def repeated_filter(hashes: DataFrame, n: int, most: int = MAX_FILTER_BITS) -> SegmentedFilter:
    """The filter of hashes seen twice, out of rows (h long, multi boolean), n of them.

    Each segment of the hash space has two Bloom filters in one task: `once` takes every hash, `twice` those that
    `once` had already or that a map task has marked `multi`. Only `twice` leaves the task. `once` is sized by its
    rows, `twice` by its rows up to `most` bits in all: beyond that more hashes are suspected and none is missed.
    """
    segments, twice_bits = _layout(n, most)
    once_bits = power_of_two(12 * max(n, 1) / segments)
    once_bits = max(once_bits, 64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            again = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            h, first, count = np.unique(h, return_index=True, return_counts=True)
            again = np.where(count > 1, True, again[first])
            seg = (h & np.uint64(segments - 1)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            cuts = np.flatnonzero(np.diff(seg[order])) + 1
            for own in np.split(order, cuts):
                if not len(own):
                    continue
                once, twice = state.setdefault(int(seg[own[0]]), (np.zeros(once_bits, bool), np.zeros(twice_bits, bool)))
                x, places = h[own], positions(h[own], once_bits)
                seen = again[own] | np.logical_and.reduce([once[p] for p in places])
                for p in places:
                    once[p] = True
                for p in positions(x[seen], twice_bits):
                    twice[p] = True
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes() for _, t in state.values()], pa.binary())], ["seg", "bits"])

    spark = hashes.sparkSession
    rows = hashes.select("h", "multi", F.col("h").bitwiseAND(segments - 1).alias("seg"))
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4_000_000), "seg").select("h", "multi")
    return _gather(spark, rows.mapInArrow(lean(build), "seg int, bits binary"), segments, twice_bits)


def key_filter(keys: DataFrame, most: int = MAX_FILTER_BITS) -> SegmentedFilter:
    """A Bloom filter of the long column h, which is written first; bounded as above."""
    keys, seen = staged_with(keys.select("h"), "keys", n=F.count(F.lit(1)))
    n = seen["n"]
    segments, bits = _layout(n, most)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            seg = (h & np.uint64(segments - 1)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(seg[order])) + 1):
                if len(own):
                    part = np.zeros(bits, bool)
                    for p in positions(h[own], bits):
                        part[p] = True
                    yield pa.RecordBatch.from_arrays([pa.array([int(seg[own[0]])], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["seg", "bits"])

    spark = keys.sparkSession
    near = keys.select("h", F.col("h").bitwiseAND(segments - 1).alias("seg")).repartition(F.col("seg")).sortWithinPartitions("seg").select("h")
    return _gather(spark, near.mapInArrow(lean(build), "seg int, bits binary"), segments, bits)


def id_hash(col: str):
    """The hash of an integer id column as `key_filter` wants it."""
    return F.xxhash64(F.col(col))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def column_free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
