"""The metrics and rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PAIR = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
_NORMS = "sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))"
#: Name, parameters, result type and body of each.
FUNCTIONS = (
    ("vector_dot_distance", _PAIR, "DOUBLE", f"-{_DOT}"),
    ("vector_euclidean_distance", _PAIR, "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))"),
    ("vector_cosine_distance", _PAIR, "DOUBLE", f"CASE WHEN {_NORMS} > 0 THEN 1 - {_DOT} / ({_NORMS}) END"),
    ("vector_shard", "id STRING, n INT", "INT", "CAST(pmod(CAST(conv(substring(md5(id), 1, 8), 16, 10) AS BIGINT), n) AS INT)"),
    ("search_k", "k INT", "INT", "least(coalesce(k, 10), 100)"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql in this session."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
