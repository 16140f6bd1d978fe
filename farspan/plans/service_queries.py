"""More registered queries: request bodies, upserts, key-value reads, filters, collections, limits and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import requests as R
from ..functions import sql
from ..functions import validation as V
from ..operators import ann, hnsw, knn, monitor, service
from ..sources import tables
from .registry import CAPACITY, KV_SQL, STATUS, asked, dimension, events, graph_shards, knn_sql, kv_log, query, read, requests, vectors


@query("SELECT vec_id, vec_id::VARCHAR AS id, len(embedding)::INTEGER AS size, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, label FROM embeddings")
def json_insert_requests(spark, sf_dir):
    """Insert bodies, read by their schema."""
    v = vectors(spark, sf_dir)
    body = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "vector", F.struct("label").alias("metadata")))
    rows = tables.parse(v.select(F.col("id").alias("vec_id"), body.alias("body")), "body", tables.INSERT)
    return rows.select("vec_id", "id", F.size("vector").alias("size"), D.shown(F.col("vector")[0].cast("double")).alias("first"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


SEARCH_K = "CASE vec_id % 6 WHEN 0 THEN '5' WHEN 1 THEN '\"ten\"' WHEN 2 THEN '0' WHEN 3 THEN '1001' WHEN 4 THEN '2.5' END"


@query("""SELECT vec_id, CASE vec_id % 6 WHEN 1 THEN 'k: not a whole number' WHEN 2 THEN 'k: too small' WHEN 3 THEN 'k: too large' WHEN 4 THEN 'k: not a whole number' END AS error,
    CASE vec_id % 6 WHEN 0 THEN 5 WHEN 5 THEN 10 END AS k FROM embeddings""")
def json_search_requests(spark, sf_dir):
    """Search bodies with k of all kinds: the rule each breaks, and the k used."""
    k = F.expr(SEARCH_K.replace("vec_id", "id"))
    vector = F.to_json("vector")
    body = F.concat(F.lit('{"vector":'), vector, F.coalesce(F.concat(F.lit(',"k":'), k), F.lit("")), F.lit("}"))
    rows = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), body.alias("body"))
    error = V.search_error(F.col("body"))
    parsed = tables.parse(rows.select("vec_id", "body", error.alias("error")), "body", tables.SEARCH)
    return parsed.select("vec_id", "error", F.when(F.col("error").isNull(), V.clamp_k(F.col("k"))).alias("k"))


@query("SELECT page_id, url AS key, strlen(html)::BIGINT AS value_bytes FROM pages")
def json_pair_requests(spark, sf_dir):
    body = F.to_json(F.struct(F.col("url").alias("key"), F.col("html").alias("value")))
    rows = tables.parse(read(spark, sf_dir, "pages").select("page_id", body.alias("body")), "body", tables.PAIR)
    return rows.select("page_id", "key", F.octet_length("value").cast("long").alias("value_bytes"))


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'id: invalid characters' WHEN 1 THEN 'vector: empty' WHEN 2 THEN 'metadata: not an object' WHEN 3 THEN 'id: invalid characters' END AS error FROM embeddings""")
def validate_insert_bodies(spark, sf_dir):
    """The first rule a body breaks: bodies of one kind break two of them."""
    n = F.col("id") % 5
    id_ = F.when(n.isin(0, 3), "no id!").otherwise(F.col("id").cast("string"))
    vector = F.when(n.isin(1, 3), F.lit("[]")).otherwise(F.to_json("vector"))
    metadata = F.when(n.isin(2, 0), F.lit("[1]")).otherwise(F.lit('{"a":1}'))
    body = F.concat(F.lit('{"id":"'), id_, F.lit('","vector":'), vector, F.lit(',"metadata":'), metadata, F.lit("}"))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), V.insert_error(body).alias("error"))


@query("""SELECT batch, items, CASE WHEN items > 100 THEN 'too many' WHEN bad IS NOT NULL THEN 'item ' || bad END AS error FROM (
    SELECT vec_id // 120 AS batch, count(*) FILTER (WHERE (vec_id // 120) % 2 = 0 OR vec_id % 120 < 90) AS items,
        min(CASE WHEN vec_id % 41 = 5 AND ((vec_id // 120) % 2 = 0 OR vec_id % 120 < 90) THEN vec_id % 120 END) AS bad FROM embeddings GROUP BY 1)""")
def validate_batch_bodies(spark, sf_dir):
    """A batch of over 100 items, or with one bad item, is rejected whole. Every second one has 90 items, not 120."""
    v = vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / 120).cast("long")).where((F.col("batch") % 2 == 0) | (F.col("id") % 120 < 90))
    name = F.when(F.col("id") % 41 == 5, "bad id!").otherwise(F.col("id").cast("string"))
    bad = V.request_error(name, F.col("vector"), F.lit(None).cast("string")).isNotNull()
    out = v.groupBy("batch").agg(F.count("*").alias("items"), F.min(F.when(bad, F.col("id") % 120)).alias("bad"))
    return out.select("batch", "items", V.batch_error(F.col("items"), F.col("bad")).alias("error"))


@query("""SELECT vec_id // 100 AS batch, count(*) AS total, count(*) FILTER (WHERE vec_id % 130 <> 9) AS inserted, count(*) FILTER (WHERE vec_id % 130 = 9) AS failed,
    count(DISTINCT CASE WHEN vec_id % 130 <> 9 THEN vec_id % 60 END) AS distinct_ids, count(*) FILTER (WHERE vec_id % 130 = 9) = 0 AS success FROM embeddings GROUP BY 1""")
def batch_insert_outcome(spark, sf_dir):
    n = dimension(spark, sf_dir)
    v = vectors(spark, sf_dir).select(F.floor(F.col("id") / 100).cast("long").alias("batch"), F.col("id").alias("position"), (F.col("id") % 60).alias("id"), F.when(F.col("id") % 130 == 9, F.slice("vector", 1, n - 1)).otherwise(F.col("vector")).alias("vector"))
    return service.batch_outcome(v, n)


@query("""SELECT vec_id % 300 AS id, arg_max(round(embedding[1]::DOUBLE, 6), vec_id) + 0.0 AS first, any_value(least(floor(-ln(((('0x' || substr(md5((vec_id % 300)::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)) / ln(16)), 10)::INTEGER) AS level,
    arg_max(label, vec_id) AS label FROM embeddings WHERE vec_id % 50 <> 9 GROUP BY 1""")
def upsert_vectors(spark, sf_dir):
    """A log in which ids repeat: scaled vectors are normalised, those of another dimension turned away."""
    n = dimension(spark, sf_dir)
    wide = F.transform("vector", lambda x: x.cast("double") * (F.col("id") % 5 + 1))
    log = vectors(spark, sf_dir).select(F.col("id").alias("seq"), (F.col("id") % 300).alias("id"), F.when(F.col("id") % 50 == 9, F.slice(wide, 1, n - 1)).otherwise(wide).alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    out = service.upsert(log, n)
    return out.select("id", D.shown(F.col("vector")[0]).alias("first"), "level", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query(f"""SELECT 'user-' || u.user_id AS key, CASE WHEN u.user_id % 3 = 0 AND k.value IS NOT NULL THEN 'cache' WHEN k.value IS NOT NULL THEN 'storage' END AS source, k.value
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {KV_SQL} k ON k.key = 'user-' || u.user_id""")
def kv_get(spark, sf_dir):
    """Every third user's pair is in the cache."""
    from ..operators import store

    state = store.kv_state(kv_log(spark, sf_dir))
    keys = events(spark, sf_dir).select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key")).distinct()
    return service.kv_get(keys, state.where(F.substring_index("key", "-", -1).cast("long") % 3 == 0), state).select("key", "source", "value")


@query(f"""SELECT side, count(*) AS n, count(*) FILTER (WHERE value = 'new') AS fresh FROM (
    SELECT 'cached' AS side, user_id, CASE WHEN user_id % 5 = 0 THEN 'new' END AS value FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 = 0 OR (user_id % 3 = 0 AND 'user-' || user_id IN (SELECT key FROM {KV_SQL}))
    UNION ALL SELECT 'stored', user_id, CASE WHEN user_id % 5 = 0 THEN 'new' END FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 = 0 OR 'user-' || user_id IN (SELECT key FROM {KV_SQL})) GROUP BY side""")
def kv_write_through(spark, sf_dir):
    from ..operators import store

    state = store.kv_state(kv_log(spark, sf_dir))
    users = events(spark, sf_dir).select("user_id").distinct().where("user_id % 5 = 0")
    puts = users.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.lit("new").alias("value"))
    sides = service.write_through(state.where(F.substring_index("key", "-", -1).cast("long") % 3 == 0), state, puts)
    both = sides[0].withColumn("side", F.lit("cached")).unionByName(sides[1].withColumn("side", F.lit("stored")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "new").alias("fresh"))


@query("SELECT 64 AS dimension, 'cosine' AS metric, 32 AS m, 64 AS m0, 400 AS ef_construction, 200 AS ef_search, round(1 / ln(32), 6) AS level_factor, 0::BIGINT AS num_vectors WHERE (SELECT max(len(embedding)) FROM embeddings) = 64")
def set_config(spark, sf_dir):
    c = hnsw.PRESETS["high_quality"]
    out = service.configured(spark, dimension(spark, sf_dir), "cosine", c.m, c.ef_construction, c.ef_search)
    return out.withColumn("level_factor", D.shown(F.col("level_factor")))


@query("SELECT max(len(embedding))::INTEGER AS dimension FROM embeddings")
def get_config(spark, sf_dir):
    return service.configured(spark, dimension(spark, sf_dir)).select("dimension")


@query("SELECT max(least(floor(-ln(((('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)) / ln(16)), 10)::INTEGER) AS entry_point_level FROM embeddings")
def entry_point_level(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.max(R.level_of(F.col("id"))).alias("entry_point_level"))


@query(f"SELECT count(DISTINCT user_id) AS tracked_keys, {CAPACITY} AS capacity FROM events")
def limiter_stats(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count_distinct("user_id").alias("tracked_keys")).withColumn("capacity", F.lit(CAPACITY))


@query(f"SELECT sum(ok)::BIGINT AS success, sum(bad)::BIGINT AS failed, count(*) AS users FROM (SELECT user_id, count(*) FILTER (WHERE {STATUS} < 500) AS ok, count(*) FILTER (WHERE {STATUS} >= 500) AS bad FROM events GROUP BY user_id)")
def user_totals(spark, sf_dir):
    r = requests(spark, sf_dir).join(events(spark, sf_dir).select("event_id", "user_id"), "event_id")
    users = r.groupBy("user_id").agg(F.count_if(F.col("status") < 500).alias("ok"), F.count_if(F.col("status") >= 500).alias("bad"))
    return users.agg(F.sum("ok").alias("success"), F.sum("bad").alias("failed"), F.count("*").alias("users"))


@query("SELECT user_id, count(*) * 1000 // (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) + 1) AS per_second, count(*) AS n FROM events GROUP BY user_id")
def throughput_by_user(spark, sf_dir):
    """n * 1000 div (ms + 1) over each user's span."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), (F.max(R.millis(F.col("ts"))) - F.min(R.millis(F.col("ts")))).alias("ms"))
    return e.select("user_id", F.expr("n * 1000 div (ms + 1)").alias("per_second"), "n")


@query(f"SELECT 'GET' AS method, 'v' || user_id % 2 AS version, count(*) AS n, round(avg(value), 6) + 0.0 AS avg_ms, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, count(*) FILTER (WHERE {STATUS} >= 500) AS failed FROM events WHERE event_type = 'click' GROUP BY 2")
def analytics_by_version(spark, sf_dir):
    """Latency and errors of one path, by method and version."""
    r = requests(spark, sf_dir).join(events(spark, sf_dir).select("event_id", F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("version")), "event_id").where("path = '/api/click'")
    out = monitor.latency_summary(r, "method", "version").join(monitor.error_rate(r, "method", "version"), ["method", "version"])
    return out.select("method", "version", "n", D.shown(F.col("avg_ms")).alias("avg_ms"), D.shown(F.col("p95")).alias("p95"), "failed")


@query(knn_sql(where="a.label < 6 AND a.label >= 2 AND a.vec_id % 2 = 0"))
def knn_metadata_filter(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))))
    return knn.knn(v.where(service.metadata_filter('{"label": {"lt": 6, "gte": 2}, "kind": "even"}', F.col("metadata"))), asked(v))


@query("""SELECT collection, qid, id, rank FROM (SELECT a.label % 3 AS collection, q.vec_id AS qid, a.vec_id AS id, row_number() OVER (PARTITION BY a.label % 3, q.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), a.vec_id) AS rank
    FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_collections(spark, sf_dir):
    """The best five of every collection."""
    v = vectors(spark, sf_dir)
    parts = [knn.knn(v.where(F.col("label") % 3 == c), asked(v), 5).withColumn("collection", F.lit(c)) for c in range(3)]
    return service.best_of_collections(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5).select("collection", "qid", "id", "rank")


@query("SELECT event_id, event_id % 4 = 0 AS limited, CASE WHEN event_id % 4 = 0 THEN 60 END AS retry_after FROM events")
def gateway_limit(spark, sf_dir):
    left = F.when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise((F.col("event_id") % 4).cast("string"))
    return events(spark, sf_dir).select("event_id", R.over_quota(left).alias("limited"), F.when(R.over_quota(left), R.RETRY_SECONDS).alias("retry_after"))


@query("SELECT page_id, limit_ms, page_id * 37 % 40000 > limit_ms AS timed_out, greatest(0, limit_ms - page_id * 37 % 40000) AS remaining_ms FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 10000 WHEN 1 THEN 5000 ELSE 30000 END AS limit_ms FROM pages)")
def timeout_by_path(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 == 0, "/api/vector/search").when(F.col("page_id") % 3 == 1, "/health").otherwise("/api/get/x")
    took = R.elapsed_ms(F.col("page_id") * 37 % 40000 + 5, F.lit(5))
    p = read(spark, sf_dir, "pages").select("page_id", R.timeout_ms(path).alias("limit_ms"), took.alias("took"))
    return p.select("page_id", "limit_ms", (F.col("took") > F.col("limit_ms")).alias("timed_out"), R.remaining_ms(F.col("limit_ms"), F.col("took")).alias("remaining_ms"))


@query("SELECT user_id, (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 1000 AS uptime FROM events GROUP BY user_id")
def uptime_by_user(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("now"))
    return e.select("user_id", R.uptime_seconds(F.col("now"), F.col("start")).alias("uptime"))


@query(f"SELECT qid, id, CAST(CAST(round(score::DECIMAL(38,12) * 100, 1) AS DECIMAL(38,1)) AS VARCHAR) || '%' AS score, CAST(CAST(round(distance::DECIMAL(38,12), 4) AS DECIMAL(38,4)) AS VARCHAR) AS distance FROM ({knn_sql()})")
def results_shown(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = knn.knn(v, asked(v))
    return found.select("qid", "id", R.score_text(F.col("score").cast("decimal(38,12)")).alias("score"), R.distance_text(F.col("distance")).alias("distance"))


@query("SELECT label, CAST(CAST(round((100 * count(*) FILTER (WHERE vec_id % 7 = 0))::DECIMAL(38,12) / count(*), 1) AS DECIMAL(38,1)) AS VARCHAR) AS deleted_percent, CASE WHEN 100.0 * count(*) FILTER (WHERE vec_id % 7 = 0) > 50 * count(*) THEN 'rebuild now' WHEN 100.0 * count(*) FILTER (WHERE vec_id % 7 = 0) > 25 * count(*) THEN 'rebuild soon' WHEN 100.0 * count(*) FILTER (WHERE vec_id % 7 = 0) > 10 * count(*) THEN 'watch' ELSE 'healthy' END AS advice FROM embeddings GROUP BY label")
def deletion_by_label(spark, sf_dir):
    v = vectors(spark, sf_dir).groupBy("label").agg(F.count_if("deleted").alias("gone"), F.count("*").alias("n"))
    percent = F.col("gone") * 100 / F.col("n")
    return v.select("label", R.one_decimal(percent).alias("deleted_percent"), R.rebuild_advice(percent).alias("advice"))


@query("SELECT unnest(range(10))::INTEGER AS shard, 'vector-index-' || unnest(range(10)) AS name, (SELECT count(*) FROM embeddings) AS vectors")
def shard_list(spark, sf_dir):
    n = vectors(spark, sf_dir).agg(F.count("*").alias("vectors"))
    return n.select(F.explode(R.shard_list(10)).alias("shard"), "vectors").select("shard", R.shard_name(F.col("shard")).alias("name"), "vectors")


@query(f"SELECT src, count(*) AS neighbours FROM (SELECT qid AS src, id AS dst FROM ({knn_sql()}) UNION SELECT id, qid FROM ({knn_sql()})) GROUP BY src")
def neighbour_edges(spark, sf_dir):
    """Links between queries and their neighbours, as a set that holds both directions."""
    v = vectors(spark, sf_dir)
    links = knn.knn(v, asked(v)).select(F.col("qid").alias("src"), F.col("id").alias("dst"))
    return service.undirected(links).groupBy("src").agg(F.count("*").alias("neighbours"))


@query("""SELECT a.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS euclidean, round(-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS dot,
    (('0x' || substr(md5(a.vec_id::VARCHAR), 1, 8))::BIGINT % 10)::INTEGER AS shard, least(coalesce(a.label * 20, 10), 100) AS k FROM embeddings a, embeddings b WHERE b.vec_id = 0""")
def sql_functions(spark, sf_dir):
    """The functions as SQL knows them."""
    sql.register(spark)
    v = vectors(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"), "label")
    one = v.where("id = 0").select(F.col("vector").alias("other"))
    both = v.join(F.broadcast(one))  # one row
    shown = lambda f: f"round(vector_{f}_distance(vector, other), 6) + 0D AS {f}"
    return both.selectExpr("id", *(shown(f) for f in ("cosine", "euclidean", "dot")), "vector_shard(cast(id AS string), 10) AS shard", "search_k(label * 20) AS k")


def _recall(name: str, found) -> None:
    """Whether the search finds nine of ten true neighbours of the stated queries."""

    def run(spark, sf_dir) -> DataFrame:
        v = vectors(spark, sf_dir)
        exact = knn.knn(v, asked(v)).select("qid", "id")
        both = exact.join(found(spark, sf_dir, v).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
        return both.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))

    run.__name__ = name
    query(f"SELECT count(*) AS neighbours, true AS enough FROM ({knn_sql()})")(run)


_recall("lsh_recall", lambda spark, sf_dir, v: ann.lsh_search(v, asked(v), dimension(spark, sf_dir)))
_recall("ivf_recall", lambda spark, sf_dir, v: ann.ivf_search(v, asked(v), ann.centroids_of(v, dimension(spark, sf_dir))))

#: Rows of one graph shard whose recall is measured, about: what is found in a shard falls with its rows, so the shards grow in number.
RECALL_ROWS = 4000


def _found_by_graph(spark, sf_dir, v: DataFrame) -> DataFrame:
    n = graph_shards(spark, sf_dir, RECALL_ROWS)
    return hnsw.search(hnsw.build(v.select("id", "vector"), shards=n), asked(v), shards=n)


_recall("hnsw_recall", _found_by_graph)
