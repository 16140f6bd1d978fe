"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are hashed in chunks (all chunks of a text at once, as one matrix product) and the chunks' hashes are
joined by length-shifted arithmetic: H(ab) = H(a) * B^|b| + H(b). Texts with equal fingerprints are then compared
chunk by chunk; only those texts leave their tasks, as chunks, and every chunk of a group is reduced to its least and
greatest value on the map side already, so that a group of any size costs one row for each task and chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, key_filter, lean, prepare, release, shared_with, staged, texts_of

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_017)
CHUNK = 4096
#: Bytes of a chunk as compared.
COMPARED = 32_768
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
MANY = re.compile(rb" {2,}")


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    text = text.translate(SPACES)
    return MANY.sub(b" ", text) if b"  " in text else text


def _powers() -> np.ndarray:
    out = np.empty((CHUNK, 2))
    for j, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, j] = x
            x = x * b % p
    return out


#: Powers for one chunk: 256 * 2^31 * 4096 stays under 2^53, so float64 products and sums are exact.
POWERS = _powers()


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (length, h1, h2) of two texts one after the other."""
    n, m = left[0], right[0]
    return (n + m, *((a * pow(b, m, p) + c) % p for a, c, b, p in zip(left[1:], right[1:], BASES, PRIMES, strict=True)))


def fingerprint(text: bytes) -> tuple[int, int, int]:
    total = (0, 0, 0)
    for at in range(0, len(text), 256 * CHUNK):  # a block of 1 MiB at a time, whatever the text's length
        part = np.frombuffer(text, np.uint8, min(256 * CHUNK, len(text) - at), at)
        whole = len(part) // CHUNK
        sums = (part[: whole * CHUNK].reshape(whole, CHUNK) + 1.0) @ POWERS if whole else ()
        tail = (part[whole * CHUNK :] + 1.0) @ POWERS[CHUNK - (len(part) - whole * CHUNK) :]
        for row in sums:
            total = combine(total, (CHUNK, int(row[0]) % PRIMES[0], int(row[1]) % PRIMES[1]))
        total = combine(total, (len(part) - whole * CHUNK, int(tail[0]) % PRIMES[0], int(tail[1]) % PRIMES[1]))
    return total


def key_of(prints: list[tuple[int, int, int]]) -> np.ndarray:
    """A 64-bit key of each fingerprint, for the filter of repeated ones."""
    x = np.array(prints, np.int64).reshape(-1, 3).view(np.uint64)
    mixed = x[:, 0] * np.uint64(ODD[0]) ^ x[:, 1] * np.uint64(ODD[1]) ^ x[:, 2] * np.uint64(ODD[2])
    return (mixed ^ mixed >> np.uint64(31)) * np.uint64(ODD[1])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalise(t) for t in texts_of(batch)]
        prints = [fingerprint(t) for t in texts]
        cols = [pa.array([x[i] for x in prints], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(key_of(prints).view(np.int64)), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "len", "h1", "h2", "h", "sha"])


def find_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, sha (binary SHA-256 of the normalised text).

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays (a null doc_id comes last); where
    rows repeat a doc_id too, exactly one of them is kept. A very long text is hashed in blocks and compared in chunks.
    Other columns of docs are ignored, whatever their names.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = staged(docs.mapInArrow(lean(_fingerprints), "doc_id long, len long, h1 long, h2 long, h long, sha binary").withColumn("rid", F.monotonically_increasing_id()), "prints")
    key = ["len", "h1", "h2"]
    repeated = prints.groupBy(*key).agg(F.count("*").alias("n"), F.first("h").alias("h")).where("n > 1").select("h")
    suspected = shared_with(spark, key_filter(repeated))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(t) for t in texts_of(batch)]
            prints = [fingerprint(t) for t in texts]
            rows = [(*prints[i], at // COMPARED, texts[i][at : at + COMPARED]) for i in np.flatnonzero(suspected.value.test(key_of(prints))) for at in range(0, max(1, len(texts[i])), COMPARED)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], pa.int64()) for j in range(4)), pa.array([r[4] for r in rows], pa.binary())], [*key, "chunk", "part"])

    parts = docs.select("text").mapInArrow(lean(chunks), "len long, h1 long, h2 long, chunk long, part binary")
    differ = staged(parts.groupBy(*key, "chunk").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select(*key).distinct(), "differ")
    release(suspected)
    if differ.isEmpty():
        keyed = prints.withColumn("own", F.lit(None).cast("binary"))
    else:  # fingerprints of unlike texts: there the text's SHA-256 parts the group
        keyed = prints.join(differ.withColumn("unlike", F.lit(True)), key, "left").withColumn("own", F.when(F.col("unlike"), F.col("sha"))).drop("unlike")
    keyed = keyed.withColumn("own", F.coalesce("own", F.lit(b"")))
    # written, so that the join has shuffles of its own, which can split a hot text
    groups = staged(keyed.groupBy(*key, "own").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("first"), F.count("*").alias("group_size")), "groups")
    return keyed.join(groups, [*key, "own"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha")
