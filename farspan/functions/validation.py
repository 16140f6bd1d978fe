"""Request rules as columns: the reason of a rejection, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ID_BYTES, MAX_DIMENSION, MAX_METADATA_BYTES, MAX_K, MAX_KEY_BYTES, MAX_BATCH = 256, 4096, 32_768, 1000, 512, 100


def id_error(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "empty").when(F.octet_length(c) > MAX_ID_BYTES, "too long").when(~c.rlike(r"^[\p{L}\p{N}_-]+$"), "invalid characters")


def vector_error(c: Column) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(c.isNull() | (F.size(c) == 0), "empty").when(F.size(c) > MAX_DIMENSION, "too long").when(~finite, "not finite")


def first_bad_index(c: Column) -> Column:
    """The place (from 0) of the first element that isn't finite, else null."""
    bad = F.transform(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.array_contains(bad, True), F.array_position(bad, True) - 1)


def metadata_error(c: Column) -> Column:
    """c: JSON text; an object or null of 32 KiB at most."""
    parsed = F.try_parse_json(c)
    return F.when(c.isNull() | (F.trim(c) == "null"), None).when(parsed.isNull(), "not JSON").when(~F.trim(c).startswith("{"), "not an object").when(F.octet_length(F.to_json(parsed)) > MAX_METADATA_BYTES, "too large")


def k_error(c: Column) -> Column:
    return F.when(c < 1, "too small").when(c > MAX_K, "too large")


def key_error(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "empty").when(F.octet_length(c) > MAX_KEY_BYTES, "too long")


def request_error(id_: Column, vector: Column, metadata: Column) -> Column:
    """The first rule that an insert breaks: id, vector, metadata."""
    return F.coalesce(F.concat(F.lit("id: "), id_error(id_)), F.concat(F.lit("vector: "), vector_error(vector)), F.concat(F.lit("metadata: "), metadata_error(metadata)))


def insert_error(body: Column) -> Column:
    """The first rule that a JSON insert body breaks, in the order id, vector, metadata; null if none."""
    parsed = F.from_json(body, "id string, vector array<double>, metadata string")
    return F.when(parsed.isNull() | F.try_parse_json(body).isNull(), "not JSON").otherwise(request_error(parsed["id"], parsed["vector"], parsed["metadata"]))


def search_error(body: Column) -> Column:
    """The rule that a JSON search body breaks, or null: a vector, then k within bounds if it is a whole number. Any
    other k passes for the default at first, but doesn't parse as a number then."""
    parsed = F.from_json(body, "vector array<double>, k string")
    k = F.when(parsed["k"].rlike("^-?[0-9]+$"), parsed["k"].try_cast("long"))
    wrong = F.when(parsed["k"].isNotNull() & k.isNull(), "k: not a whole number")
    return F.coalesce(F.concat(F.lit("vector: "), vector_error(parsed["vector"])), F.concat(F.lit("k: "), k_error(k)), wrong)


def batch_error(items: Column, bad_at: Column) -> Column:
    """items: how many a batch has; bad_at: the place of its first bad one. One bad item rejects the batch."""
    return F.when(items.isNull() | (items < 1), "empty").when(items > MAX_BATCH, "too many").when(bad_at.isNotNull(), F.concat(F.lit("item "), bad_at.cast("string")))


def clamp_k(c: Column) -> Column:
    """10 by default, 100 at most."""
    return F.least(F.coalesce(c, F.lit(10)), F.lit(100))
