"""Repeated lines, found by two Bloom filters and confirmed exactly.

Pass 1 sends the 64-bit hashes of each task's distinct long lines to the filters `once` and `twice` of their segment
(`common.repeated_filter`). Pass 2 tests every line against `twice`: only suspected lines are shuffled as text, and
counted exactly. Pass 3 takes the confirmed lines out of their documents, and shuffles only documents that a filter of
their ids suspects to lose any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_free_name, id_hash, key_filter, lean, prepare, release, repeated_filter, shared_with, staged, staged_with, texts_of

BLANK = b" \t\n\v\f\r"
#: Hashes that a map task gathers before it sends them on.
GATHERED = 400_000


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # of bytes: A-Z only


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def long_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if is_long(k, least)}


def _signed(values) -> np.ndarray:
    return np.fromiter(values, np.uint64).view(np.int64)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with `text` cut to the lines that stay, and columns n_lines and n_dropped (suffixed _ where taken).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of min_chars code points or
    more that min_docs rows or more hold loses all its lines but those of the largest doc_id that holds it. Null text
    is one empty line and stays null if nothing is dropped. Rows that repeat a doc_id count as documents of their own
    and share its fate; a null doc_id is smaller than any other, and if no holder has an id, all keep their lines.
    A very long text or line is read whole by the task that holds it. Other columns pass unchanged, whatever their
    names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_signed(seen)), pa.array(list(seen.values()), pa.bool_())], ["h", "multi"])

        for batch in batches:
            for text in texts_of(batch):
                for key in long_keys(text, min_chars):
                    h = xxhash.xxh3_64_intdigest(key)
                    seen[h] = h in seen
                if len(seen) >= GATHERED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    hashes, seen = staged_with(plain.select("text").mapInArrow(lean(hashed), "h long, multi boolean"), "lines", n=F.count(F.lit(1)))
    twice = shared_with(spark, repeated_filter(hashes, seen["n"]))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, owner = batch.column("doc_id"), [], []
            for i, text in enumerate(texts_of(batch)):
                own = long_keys(text, min_chars)
                keys += own
                owner += [i] * len(own)
            if keys:
                hit = twice.value.test(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                at = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(owner)[at])), pa.array([keys[i] for i in at], pa.binary())], ["doc_id", "key"])

    lines = staged(plain.mapInArrow(lean(suspected), "doc_id long, key binary"), "suspected")
    release(twice)
    confirmed = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    confirmed = staged(confirmed, "confirmed")  # so that the join has shuffles of its own, which can split a hot line
    out = {c: column_free_name(docs, c) for c in ("_gone_id", "_gone", "_cut", "n_lines", "n_dropped")}
    gone = lines.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull())
    gone = staged(gone.groupBy(F.col("doc_id").alias(out["_gone_id"])).agg(F.collect_set("key").alias(out["_gone"])), "gone")
    touched = shared_with(spark, key_filter(gone.select(id_hash(out["_gone_id"]).alias("h"))))

    @F.arrow_udf("boolean")
    def may_lose(h: pa.Array) -> pa.Array:
        return pa.array(touched.value.test(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    @F.arrow_udf("struct<kept string, n_lines long, n_dropped long>")
    def cut(text: pa.Array, keys: pa.Array) -> pa.Array:
        kept, lines, dropped = [], [], []
        for t, own in zip(text.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
            if not own or t is None:
                kept.append(t)
                lines.append((t or b"").count(b"\n") + 1)
                dropped.append(0)
                continue
            own, all_lines = set(own), t.split(b"\n")
            stay = [x for x in all_lines if line_key(x) not in own]
            kept.append(b"\n".join(stay))
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["kept", "n_lines", "n_dropped"])

    # only documents that may lose a line meet the lines; the others pass in place
    hit = may_lose(F.xxhash64(F.col("doc_id").cast("long")))
    met = docs.where(hit).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(out["_gone_id"])), "left").drop(out["_gone_id"])
    met = met.withColumn(out["_cut"], cut(F.col("text").cast("string"), F.col(out["_gone"]))).drop(out["_gone"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines_of = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    whole = F.struct(F.col("text").cast("string").alias("kept"), lines_of.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    both = met.unionByName(docs.where(~hit).withColumn(out["_cut"], whole))
    names = [F.col(out["_cut"])["kept"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*names, *(F.col(out["_cut"])[c].alias(out[c]) for c in ("n_lines", "n_dropped")))
