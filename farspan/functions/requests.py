"""Request analytics, routing and formatting as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_level(status: Column, ms: Column) -> Column:
    return F.when(status >= 500, "ERROR").when((status >= 400) | (ms > 500), "WARN").otherwise("INFO")


def log_line(method: Column, path: Column, status: Column, ms: Column) -> Column:
    return F.concat(F.lit("["), log_level(status, ms), F.lit("] "), method, F.lit(" "), path, F.lit(" - "), status.cast("string"), F.lit(" ("), ms.cast("string"), F.lit("ms)"))


def is_protected(path: Column) -> Column:
    return path.startswith("/api/")


def api_key(authorization: Column, header: Column) -> Column:
    bearer = F.regexp_extract(authorization, r"^Bearer (.+)$", 1)
    return F.coalesce(F.when(bearer != "", bearer), F.when(header != "", header))


def masked(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("..."), F.right(key, F.lit(8)))


def path_parameter(path: Column) -> Column:
    return F.regexp_replace(path, "^/(get|delete)/", "")


def shard_of(key: Column, n: int) -> Column:
    """By the first 8 hex digits of the key's MD5: the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def shard_name(shard: Column) -> Column:
    return F.concat(F.lit("vector-index-"), shard.cast("string"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.999999, "exact").when(score >= 0.8, "very similar").when(score >= 0.6, "somewhat similar").otherwise("loosely related")


def level_of(key: Column, m: int = 16, top: int = 10) -> Column:
    """The graph level of a key, drawn from its MD5: floor(-ln(U) / ln(m)), top at most."""
    u = (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.least(F.floor(-F.log(u) / F.log(F.lit(float(m)))), F.lit(top)).cast("int")


def millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


#: Milliseconds that a request may take, by what it asks for. Fixed values.
TIMEOUTS = {"default": 30_000, "vector": 10_000, "health": 5_000}


def timeout_ms(path: Column) -> Column:
    return F.when(path.startswith("/api/vector/"), TIMEOUTS["vector"]).when(path == "/health", TIMEOUTS["health"]).otherwise(TIMEOUTS["default"])


def over_quota(remaining: Column) -> Column:
    """Whether the gateway's header says that nothing is left; then to be tried again after RETRY_SECONDS."""
    return F.coalesce(remaining == "0", F.lit(False))


#: Fixed value.
RETRY_SECONDS = 60


def one_decimal(x: Column) -> Column:
    """Text with one decimal, half away from zero."""
    return F.round(x.cast("decimal(38,12)"), 1).cast("decimal(38,1)").cast("string")


def score_text(score: Column) -> Column:
    return F.concat(one_decimal(score * 100), F.lit("%"))


def distance_text(distance: Column) -> Column:
    return F.round(distance.cast("decimal(38,12)"), 4).cast("decimal(38,4)").cast("string")


def shard_list(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def elapsed_ms(now: Column, start: Column) -> Column:
    return now - start


def uptime_seconds(now_ms: Column, start_ms: Column) -> Column:
    return F.coalesce(F.floor((now_ms - start_ms) / 1000), F.lit(0)).cast("long")


def remaining_ms(limit: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0), limit - elapsed)


def rebuild_advice(percent: Column) -> Column:
    return F.when(percent > 50, "rebuild now").when(percent > 25, "rebuild soon").when(percent > 10, "watch").otherwise("healthy")
