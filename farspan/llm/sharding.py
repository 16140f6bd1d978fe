"""Jump consistent hashing (Lamping and Veach) in column expressions, without a ring table.

The published generator k = k * 2862933555777941757 + 1 (mod 2^64) runs on two 32-bit halves, since SQL integers have
no wrapping product. One more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, LOW, HALF = 0x27BB2EE6, 0x87B0B0FD, 0xFFFFFFFF
#: Rows of one shard that one window group has, about.
SLOT_ROWS = 50_000


def _low_product(a: Column, c: int) -> Column:
    """The low 32 bits of a * c, both under 2^32."""
    high = F.shiftright(a, 16) * F.lit(c)
    return (a.bitwiseAND(0xFFFF) * F.lit(c) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(HALF)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0 .. shards-1 of a long key. A null key counts as 0."""
    key = F.coalesce(key, F.lit(0).cast("long"))

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        high = F.shiftright(lo, 16) * F.lit(LOW)
        low = lo.bitwiseAND(0xFFFF) * F.lit(LOW) + F.shiftleft(high.bitwiseAND(0xFFFF), 16) + F.lit(1)
        new_hi = (F.shiftright(low, 32) + F.shiftright(high, 16) + _low_product(hi, LOW) + _low_product(lo, HIGH)).bitwiseAND(HALF)
        drawn = F.struct(low.bitwiseAND(HALF).alias("lo"), new_hi.alias("hi"), s["j"].alias("b"))
        leap = F.transform(F.array(drawn), lambda d: F.struct(d["lo"].alias("lo"), d["hi"].alias("hi"), d["b"].alias("b"), F.floor((d["b"] + 1) * (F.lit(2147483648.0) / (F.shiftright(d["hi"], 1) + 1))).cast("long").alias("j")))
        return F.when(s["j"] >= shards, s).otherwise(leap[0])

    start = F.struct(key.bitwiseAND(HALF).alias("lo"), F.shiftrightunsigned(key, 32).bitwiseAND(HALF).alias("hi"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, shard, slot (gapless from 0 in the
    shard), grown_shard (with one shard more). Rows that repeat a doc_id share its shard and get slots of their own; a
    null doc_id hashes as a key of its own. Rows alike in id, size and crc take slots in any order. Of a very long text
    only size and crc are kept. Other columns are ignored. An empty table gives an empty result.

    Slots: rows are numbered in small groups (a shard's rows by a hash of id and text, about SLOT_ROWS each); the groups'
    offsets come from counts. The window and the join with the offsets share one shuffle of narrow rows.
    """
    from pyspark.sql import Window

    key = F.xxhash64(F.col("doc_id").cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    groups = max(64, docs.count() // (shards * SLOT_ROWS))
    crc = F.crc32(text.cast("binary"))
    part = F.pmod(F.xxhash64(key, crc), F.lit(groups)).cast("int").alias("part")  # rows that share an id part by their texts
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"), jump_shard(key, shards).alias("shard"), part, jump_shard(key, shards + 1).alias("grown_shard"))
    counts = docs.select(jump_shard(key, shards).alias("shard"), part).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = base.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"), "grown_shard")
