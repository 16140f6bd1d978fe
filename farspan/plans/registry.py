"""Queries over the driver's tables and, where SQL can say it, the same in DuckDB SQL.

`embeddings` is the vector store, `events` the request stream and mutation log, `documents` the key-value pairs. A
search takes as queries every vector whose id is divisible by 20 and looks among all. Marks of deletion (id divisible
by 7) are part of the made-up state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import requests as R
from ..functions import validation as V
from ..operators import ann, hnsw, knn, limits, monitor, store
from ..sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", (F.col("vec_id") % 7 == 0).alias("deleted"))


def asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vector")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t"))


def keyed(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("t").alias("ms"))


SQL_METRIC = {
    "cosine": "1 - list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "euclidean": "list_distance(a.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "dotproduct": "-list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[])",
}


def knn_sql(metric: str = "cosine", where: str = "true", ranks: str = "rank BETWEEN 1 AND 10") -> str:
    return f"""SELECT qid, rank, id, round(d, 6) + 0.0 AS distance, round(1 - d, 6) + 0.0 AS score FROM (
        SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (
            SELECT q.vec_id AS qid, a.vec_id AS id, round({SQL_METRIC[metric]}, 9) AS d FROM embeddings a, embeddings q
            WHERE q.vec_id % 20 = 0 AND {where})) WHERE {ranks}"""


def _knn(name: str, metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return knn.knn(v, asked(v), 10, metric)

    run.__name__ = name
    query(knn_sql(metric))(run)


_knn("knn_cosine", "cosine")
_knn("knn_euclidean", "euclidean")
_knn("knn_dot", "dotproduct")


@query(knn_sql(where="a.vec_id <> q.vec_id"))
def knn_item_to_item(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.knn(v, asked(v), 10, drop_self=True)


@query(knn_sql(where="a.label = 3"))
def knn_filtered(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return knn.knn(v.where(F.get_json_object("metadata", "$.label") == "3"), asked(v))


@query(knn_sql(where="a.vec_id % 7 <> 0"))
def knn_excluding_deleted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.knn(store.compact(v), asked(v))


@query(knn_sql(ranks="rank BETWEEN 6 AND 10"))
def knn_paged(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.page(knn.knn(v, asked(v)), 5, 5)


@query("SELECT k, CASE WHEN k < 1 THEN 'too small' WHEN k > 1000 THEN 'too large' END AS error, least(coalesce(k, 10), 100)::INTEGER AS used FROM (VALUES (NULL), (0), (1), (10), (100), (101), (1000), (1001)) t(k)")
def knn_k_clamp(spark, sf_dir):
    k = spark.createDataFrame([(x,) for x in (None, 0, 1, 10, 100, 101, 1000, 1001)], "k int")
    return k.select("k", V.k_error(F.col("k")).alias("error"), V.clamp_k(F.col("k")).alias("used"))


@query(f"SELECT qid, id, CASE WHEN score >= 0.999999 THEN 'exact' WHEN score >= 0.8 THEN 'very similar' WHEN score >= 0.6 THEN 'somewhat similar' ELSE 'loosely related' END AS band FROM ({knn_sql()})")
def knn_score_bands(spark, sf_dir):
    return knn_cosine_result(spark, sf_dir).select("qid", "id", R.score_band(F.col("score")).alias("band"))


def knn_cosine_result(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.knn(v, asked(v))


@query(f"SELECT qid, score, score < 0.5 AS anomaly FROM ({knn_sql(where='a.vec_id <> q.vec_id', ranks='rank = 1')})")
def anomaly_nearest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.knn(v, asked(v), 1, drop_self=True).select("qid", "score", (F.col("score") < 0.5).alias("anomaly"))


@query("""SELECT vec_id AS id, round(sqrt(list_inner_product(u, u)), 6) + 0.0 AS norm, round(u[1], 6) + 0.0 AS first FROM (
    SELECT vec_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS u FROM (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5 + 1)) AS s FROM embeddings))""")
def normalize_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.transform("vector", lambda x: x.cast("double") * (F.col("id") % 5 + 1)).alias("v"))
    v = v.select("id", D.normalize(F.col("v")).alias("u"))
    return v.select("id", D.shown(D.norm(F.col("u"))).alias("norm"), D.shown(F.col("u")[0]).alias("first"))


CENTROID_SQL = """WITH c AS (SELECT label AS cell, i, avg(x) AS x FROM (SELECT label, unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
    m AS (SELECT cell, list(x ORDER BY i) AS centre FROM c GROUP BY cell)"""


@query(CENTROID_SQL + " SELECT cell, round(sqrt(list_inner_product(centre, centre)), 6) + 0.0 AS norm, round(centre[1], 6) + 0.0 AS first FROM m")
def label_centroids(spark, sf_dir):
    c = ann.centroids_of(vectors(spark, sf_dir), dimension(spark, sf_dir))
    return c.select("cell", D.shown(D.norm(F.col("centre"))).alias("norm"), D.shown(F.col("centre")[0]).alias("first"))


def dimension(spark, sf_dir) -> int:
    return vectors(spark, sf_dir).agg(F.max(F.size("vector"))).first()[0] or 1


@query(CENTROID_SQL + """ SELECT vec_id AS id, arg_min(cell, d) AS cell, round(min(d), 6) + 0.0 AS distance FROM (
    SELECT vec_id, cell, 1 - list_cosine_similarity(embedding::DOUBLE[], centre) AS d FROM embeddings, m) GROUP BY vec_id""")
def nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = ann.cells_of(v, "id", ann.centroids_of(v, dimension(spark, sf_dir)))
    return near.select("id", F.col("cell").cast("int").alias("cell"), D.shown(F.col("cd")).alias("distance"))


@query("SELECT vec_id AS id, CASE WHEN len(v) = 0 THEN 'empty' WHEN list_contains(list_transform(v, lambda x: isnan(x)), true) THEN 'not finite' END AS error, CASE WHEN vec_id % 3 = 1 THEN 0::BIGINT END AS first_bad FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN embedding WHEN 1 THEN ['nan'::FLOAT] ELSE [] END AS v FROM embeddings)")
def validate_vectors(spark, sf_dir):
    v = F.when(F.col("id") % 3 == 0, F.col("vector")).when(F.col("id") % 3 == 1, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.array().cast("array<float>"))
    return vectors(spark, sf_dir).select("id", v.alias("v")).select("id", V.vector_error(F.col("v")).alias("error"), V.first_bad_index(F.col("v")).cast("long").alias("first_bad"))


@query("""SELECT doc_id, CASE WHEN x = '' THEN 'empty' WHEN strlen(x) > 256 THEN 'too long' WHEN NOT regexp_full_match(x, '[\\p{L}\\p{N}_-]+') THEN 'invalid characters' END AS error
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE text END AS x FROM documents)""")
def validate_ids(spark, sf_dir):
    x = F.when(F.col("doc_id") % 2 == 0, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", V.id_error(x).alias("error"))


@query("SELECT event_id, CASE WHEN NOT json_valid(m) THEN 'not JSON' WHEN json_type(m) <> 'OBJECT' THEN 'not an object' END AS error FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '{bad' ELSE props END AS m FROM events)")
def validate_metadata(spark, sf_dir):
    m = F.when(F.col("event_id") % 4 == 0, "[1]").when(F.col("event_id") % 4 == 1, "{bad").otherwise(F.col("props"))
    return events(spark, sf_dir).select("event_id", m.alias("m")).select("event_id", V.metadata_error(F.col("m")).alias("error"))


@query("SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN strlen(url) > 512 THEN 'too long' END AS error, strlen(html)::BIGINT AS value_bytes FROM pages")
def validate_kv_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", V.key_error(F.col("url")).alias("error"), F.octet_length("html").cast("long").alias("value_bytes"))


@query("""SELECT vec_id // 100 AS batch, count(*) AS items, min(CASE WHEN vec_id % 41 = 5 THEN vec_id % 100 END) AS first_bad FROM embeddings GROUP BY 1""")
def validate_batch(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("name", F.when(F.col("id") % 41 == 5, "bad id!").otherwise(F.col("id").cast("string")))
    bad = V.request_error(F.col("name"), F.col("vector"), F.lit(None).cast("string")).isNotNull()
    return v.groupBy(F.floor(F.col("id") / 100).cast("long").alias("batch")).agg(F.count("*").alias("items"), F.min(F.when(bad, F.col("id") % 100)).alias("first_bad"))


@query("SELECT vec_id % 50 = 9 AS wrong_dimension, count(*) AS total, count(*) FILTER (WHERE vec_id % 50 <> 9) AS inserted, count(*) FILTER (WHERE vec_id % 50 = 9) AS failed FROM embeddings GROUP BY 1")
def batch_insert_result(spark, sf_dir):
    n = dimension(spark, sf_dir)
    v = vectors(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 50 == 9, F.slice("vector", 1, n - 1)).otherwise(F.col("vector")))
    ok = F.size("vector") == n
    return v.groupBy((~ok).alias("wrong_dimension")).agg(F.count("*").alias("total"), F.count_if(ok).alias("inserted"), F.count_if(~ok).alias("failed"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) + 0.0 AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return store.latest(log, "id", "seq").select("id", "event_type", D.shown(F.col("value")).alias("value"), "seq")


def _flags(name: str, deleted: bool) -> None:
    done, before = ("deleted", "already_deleted") if deleted else ("restored", "not_deleted")
    mark = "v.vec_id % 7 = 0" if deleted else "v.vec_id % 7 <> 0"

    def run(spark, sf_dir):
        asked_for = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
        return store.apply_flags(vectors(spark, sf_dir), asked_for, deleted)

    run.__name__ = name
    query(f"SELECT d.doc_id AS id, CASE WHEN v.vec_id IS NULL THEN 'not_found' WHEN {mark} THEN '{before}' ELSE '{done}' END AS outcome FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN embeddings v ON v.vec_id = d.doc_id")(run)


_flags("soft_delete_outcome", True)
_flags("undelete_outcome", False)


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, label FROM embeddings WHERE vec_id = 45 AND vec_id % 7 <> 0")
def get_by_id(spark, sf_dir):
    return store.get(vectors(spark, sf_dir), 45).select("id", D.shown(F.col("vector")[0].cast("double")).alias("first"), "label")


@query("SELECT d.doc_id AS id, v.vec_id IS NOT NULL AS found FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id AND v.vec_id % 7 <> 0")
def contains_id(spark, sf_dir):
    return store.contains(vectors(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


def kv_log(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "delete").otherwise("put").alias("op"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"))


KV_SQL = "(SELECT key, value FROM (SELECT 'user-' || user_id AS key, arg_max(props, event_id) AS value, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last <> 'click')"


@query(f"SELECT key, value FROM {KV_SQL}")
def kv_state(spark, sf_dir):
    return store.kv_state(kv_log(spark, sf_dir))


@query(f"SELECT count(*) AS count, string_agg(key, ',' ORDER BY key) AS keys FROM {KV_SQL}")
def kv_list(spark, sf_dir):
    s = store.kv_state(kv_log(spark, sf_dir))
    return s.agg(F.count("*").alias("count"), F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


@query("SELECT count(*) AS num_vectors, count(*) FILTER (WHERE vec_id % 7 <> 0) AS num_active, count(*) FILTER (WHERE vec_id % 7 = 0) AS num_deleted, max(len(embedding))::INTEGER AS dimension, round(100.0 * count(*) FILTER (WHERE vec_id % 7 = 0) / count(*), 6) + 0.0 AS deleted_percent, 'watch' AS advice FROM embeddings")
def index_stats(spark, sf_dir):
    s = store.stats(vectors(spark, sf_dir))
    return s.withColumn("advice", R.rebuild_advice(F.col("deleted_percent"))).withColumn("deleted_percent", D.shown(F.col("deleted_percent")))


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY label")
def compact_active(spark, sf_dir):
    return store.compact(vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


SHARD_SQL = "(('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT % {})::INTEGER"


@query(f"SELECT doc_id, {SHARD_SQL.format('doc_id', 10)} AS shard, 'vector-index-' || {SHARD_SQL.format('doc_id', 10)} AS name FROM documents")
def shard_assign(spark, sf_dir):
    s = R.shard_of(F.col("doc_id"), 10)
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("shard"), R.shard_name(s).alias("name"))


@query(f"SELECT {SHARD_SQL.format('doc_id', 10)} AS shard, count(*) AS document_count, sum(strlen(text))::BIGINT AS storage_bytes FROM documents GROUP BY 1")
def shard_stats(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(R.shard_of(F.col("doc_id"), 10).alias("shard")).agg(F.count("*").alias("document_count"), F.sum(F.octet_length("text")).cast("long").alias("storage_bytes"))


@query(f"SELECT min(n) AS least, max(n) AS most, min(n) * 10 >= 0.7 * sum(n) AND max(n) * 10 <= 1.3 * sum(n) AS balanced FROM (SELECT {SHARD_SQL.format('doc_id', 10)} AS shard, count(*) AS n FROM documents GROUP BY 1)")
def shard_balance(spark, sf_dir):
    n = read(spark, sf_dir, "documents").groupBy(R.shard_of(F.col("doc_id"), 10).alias("shard")).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), ((F.min("n") * 10 >= 0.7 * F.sum("n")) & (F.max("n") * 10 <= 1.3 * F.sum("n"))).alias("balanced"))


@query(f"SELECT qid, id, distance, rank FROM ({knn_sql()})")
def shard_merge_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    shard = R.shard_of(F.col("id"), 4)
    parts = [knn.nearest(v.where((shard == s) | (shard == (s + 1) % 4)), asked(v)) for s in range(4)]  # each vector lies in two shards
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = knn.merge_shards(out.withColumnRenamed("d", "distance"), 10)  # merged by what ranks, not by what is shown
    return best.select("qid", "id", D.shown(F.col("distance")).alias("distance"), "rank")


def requests(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when(F.col("event_id") % 23 == 0, 503).when(F.col("event_id") % 11 == 0, 404).otherwise(200)
    return e.select("event_id", "ts", F.lit("GET").alias("method"), F.concat(F.lit("/api/"), F.col("event_type")).alias("path"), status.alias("status"), F.col("value").alias("ms"))


STATUS = "CASE WHEN event_id % 23 = 0 THEN 503 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END"


@query("SELECT '/api/' || event_type AS path, count(*) AS n, round(min(value), 6) + 0.0 AS min_ms, round(avg(value), 6) + 0.0 AS avg_ms, round(max(value), 6) + 0.0 AS max_ms, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99 FROM events GROUP BY 1")
def request_latency_summary(spark, sf_dir):
    out = monitor.latency_summary(requests(spark, sf_dir), "path")
    return out.select("path", "n", *(D.shown(F.col(c)).alias(c) for c in ("min_ms", "avg_ms", "max_ms", "p50", "p95", "p99")))


@query("SELECT '/api/' || event_type AS path, s[n // 2 + 1] AS p50, s[n * 95 // 100 + 1] AS p95, s[n * 99 // 100 + 1] AS p99 FROM (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS s FROM events GROUP BY event_type)")
def latency_index_percentiles(spark, sf_dir):
    return monitor.index_percentiles(requests(spark, sf_dir), "path")


@query(f"SELECT '/api/' || event_type AS path, count(*) AS total, count(*) FILTER (WHERE {STATUS} >= 500) AS failed, count(*) FILTER (WHERE {STATUS} >= 500) * 100 // count(*) AS error_percent FROM events GROUP BY 1")
def error_rate(spark, sf_dir):
    return monitor.error_rate(requests(spark, sf_dir), "path")


LEVEL = f"CASE WHEN {STATUS} >= 500 THEN 'ERROR' WHEN {STATUS} >= 400 OR value > 500 THEN 'WARN' ELSE 'INFO' END"


@query(f"SELECT event_id, {LEVEL} AS level, '[' || {LEVEL} || '] GET /api/' || event_type || ' - ' || {STATUS} || ' (' || floor(value)::BIGINT || 'ms)' AS line FROM events")
def request_log_line(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("event_id", R.log_level(F.col("status"), F.col("ms")).alias("level"), R.log_line(F.col("method"), F.col("path"), F.col("status"), F.floor(F.col("ms")).cast("long")).alias("line"))


def _throughput(name: str, seconds: int) -> None:
    def run(spark, sf_dir):
        return monitor.throughput(requests(spark, sf_dir), seconds).withColumn("per_second", D.shown(F.col("per_second")))

    run.__name__ = name
    query(f"SELECT epoch_us(ts) // {seconds}000000 * {seconds} AS start_s, count(*) AS n, round(count(*) / {seconds}.0, 6) + 0.0 AS per_second FROM events GROUP BY 1")(run)


_throughput("throughput_10s", 10)
_throughput("throughput_daily", 86_400)

CAPACITY, RATE = 5, 1 / 14_400
BUCKET_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
    b AS (SELECT user_id, event_id, ms, rn, {CAPACITY - 1}::DOUBLE AS tokens, true AS allowed FROM e WHERE rn = 1
        UNION ALL SELECT e.user_id, e.event_id, e.ms, e.rn, CASE WHEN t.x >= 1 THEN t.x - 1 ELSE t.x END, t.x >= 1
        FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1, LATERAL (SELECT least({CAPACITY}::DOUBLE, b.tokens + (e.ms - b.ms) / 1000.0::DOUBLE * {RATE!r}::DOUBLE) AS x) t)"""


@query(BUCKET_SQL + f" SELECT user_id, event_id, allowed, CASE WHEN allowed THEN floor(tokens)::BIGINT ELSE 0 END AS remaining, CASE WHEN NOT allowed THEN greatest(1, ceil((1 - tokens) / {RATE!r}::DOUBLE))::BIGINT END AS retry_after FROM b")
def token_bucket(spark, sf_dir):
    out = limits.token_bucket(keyed(events(spark, sf_dir)), CAPACITY, RATE)
    return out.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "allowed", "remaining", "retry_after")


END_MS = 1_706_745_600_000  # 2024-02-01 UTC


@query(BUCKET_SQL + f" SELECT user_id, least({CAPACITY}::DOUBLE, arg_max(tokens, rn) + ({END_MS} - max(ms)) / 1000.0::DOUBLE * {RATE!r}::DOUBLE) >= {CAPACITY} AS evicted FROM b GROUP BY user_id")
def bucket_cleanup(spark, sf_dir):
    out = limits.token_bucket(keyed(events(spark, sf_dir)), CAPACITY, RATE)
    return limits.inactive(out, END_MS, CAPACITY, RATE).select(F.col("key").alias("user_id"), "evicted")


WINDOW_MS = 3_600_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
    a AS (SELECT user_id, rn, ms AS anchor FROM e WHERE rn = 1 UNION ALL
        SELECT e.user_id, e.rn, CASE WHEN e.ms < a.anchor + {WINDOW_MS} THEN a.anchor WHEN e.ms < a.anchor + {2 * WINDOW_MS} THEN a.anchor + {WINDOW_MS} ELSE e.ms END FROM a JOIN e ON e.user_id = a.user_id AND e.rn = a.rn + 1)
    SELECT user_id, anchor + {WINDOW_MS} AS fire_ms, count(*) AS writes FROM a GROUP BY 1, 2""")
def flush_windows(spark, sf_dir):
    return limits.flush_windows(keyed(events(spark, sf_dir)), WINDOW_MS).withColumnRenamed("key", "user_id")


@query("SELECT event_id, value > 300 AS timed_out, round(greatest(0, 300 - value), 6) + 0.0 AS remaining_ms FROM events")
def timeout_filter(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (F.col("value") > 300).alias("timed_out"), D.shown(R.remaining_ms(F.lit(300.0), F.col("value"))).alias("remaining_ms"))


@query("""SELECT page_id, starts_with('/api/' || page_id, '/api/') AS protected, CASE WHEN page_id % 2 = 0 THEN 'token-' || md5(url) ELSE md5(url) END AS api_key, left(md5(url), 8) || '...' || right(md5(url), 8) AS masked, page_id::VARCHAR AS parameter FROM pages""")
def request_keys(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("k", F.md5(F.col("url").cast("binary")))
    auth = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Bearer token-"), F.col("k"))).otherwise(F.lit(""))
    return p.select("page_id", R.is_protected(F.concat(F.lit("/api/"), F.col("page_id").cast("string"))).alias("protected"), R.api_key(auth, F.col("k")).alias("api_key"), R.masked(F.col("k")).alias("masked"), R.path_parameter(F.concat(F.lit("/get/"), F.col("page_id").cast("string"))).alias("parameter"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_requests(spark, sf_dir):
    return tables.parse(events(spark, sf_dir).select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("SELECT vec_id // 100 AS batch, vec_id % 100 AS position, vec_id::VARCHAR AS id, len(embedding)::INTEGER AS size FROM embeddings")
def json_batches(spark, sf_dir):
    item = F.struct(F.col("id").cast("string").alias("id"), "vector")
    v = vectors(spark, sf_dir).groupBy(F.floor(F.col("id") / 100).cast("long").alias("batch"))
    bodies = v.agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("o"), item.alias("item")))), lambda x: x["item"]).alias("vectors"))).alias("body"))  # 100 items a batch
    return tables.parse_batches(bodies).select("batch", F.col("position").cast("long").alias("position"), "id", F.size("vector").alias("size"))


@query(f"SELECT qid, count(*) AS count, true AS success FROM ({knn_sql()}) GROUP BY qid")
def json_responses(spark, sf_dir):
    body = F.from_json("body", "success boolean, count long")
    return tables.responses(knn_cosine_result(spark, sf_dir)).select("qid", body["count"].alias("count"), body["success"].alias("success"))


@query("SELECT vec_id AS id, least(floor(-ln(((('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)) / ln(16)), 10)::INTEGER AS level FROM embeddings")
def hnsw_levels(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", R.level_of(F.col("id")).alias("level"))


#: Rows of one graph shard, about.
SHARD_ROWS = 400


def graph_shards(spark, sf_dir, rows: int = SHARD_ROWS) -> int:
    return max(2, -(-vectors(spark, sf_dir).count() // rows))


@query(knn_sql())
def hnsw_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    n = graph_shards(spark, sf_dir)
    return hnsw.search(hnsw.build(v.select("id", "vector"), shards=n), asked(v), shards=n)


@query(knn_sql(where="a.vec_id % 7 <> 0"))
def hnsw_search_active(spark, sf_dir):
    v = vectors(spark, sf_dir)
    n = graph_shards(spark, sf_dir)
    return hnsw.search(hnsw.build(v.select("id", "vector", "deleted"), shards=n), asked(v), shards=n)


@query()
def hnsw_layer_stats(spark, sf_dir):
    e = hnsw.edges(hnsw.build(vectors(spark, sf_dir).select("id", "vector"), shards=graph_shards(spark, sf_dir)))
    return e.groupBy("layer").agg(F.count("*").alias("connections"), F.countDistinct("src").alias("nodes"))


@query()
def lsh_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ann.lsh_search(v, asked(v), dimension(spark, sf_dir))


@query()
def ivf_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ann.ivf_search(v, asked(v), ann.centroids_of(v, dimension(spark, sf_dir)))
