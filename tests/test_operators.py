"""Units, properties and recall of the vector and request operators."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from farspan.functions import distance as D
from farspan.functions import requests as R
from farspan.functions import validation as V
from farspan.operators import ann, hnsw, knn, limits, store
from farspan.sources import tables
from farspan.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_metrics(spark):
    assert math.isclose(one(spark, D.euclidean_distance(vec(1, 2, 3, 4), vec(4, 3, 2, 1))), math.sqrt(20))
    assert abs(one(spark, D.cosine_distance(vec(1, 0, 0, 0), vec(1, 0, 0, 0)))) < 1e-9
    assert one(spark, D.dot_distance(vec(1, 2, 3, 4), vec(1, 1, 1, 1))) == -10
    assert one(spark, D.cosine_distance(vec(0, 0), vec(1, 1))) is None and one(spark, D.normalize(vec(0, 0))) == [0, 0]
    with pytest.raises(ValueError, match="unknown"):
        D.distance("hamming", vec(1), vec(1))


def test_validation(spark):
    for x, ok in (("valid_id-123", True), ("", False), ("a" * 300, False), ("invalid id!", False)):
        assert (one(spark, V.id_error(F.lit(x))) is None) == ok
    for x, ok in (([0.1, 0.2], True), ([float("nan")], False), ([float("inf")], False)):
        assert (one(spark, V.vector_error(vec(*x))) is None) == ok
    assert [one(spark, V.k_error(F.lit(k))) for k in (10, 0, 2000)] == [None, "too small", "too large"]


def test_requests(spark):
    assert [one(spark, R.is_protected(F.lit(p))) for p in ("/api/put", "/health", "/")] == [True, False, False]
    assert one(spark, R.log_line(F.lit("GET"), F.lit("/x"), F.lit(404), F.lit(3))) == "[WARN] GET /x - 404 (3ms)"
    n = [r.n for r in spark.range(1000).groupBy(R.shard_of(F.concat(F.lit("key-"), "id"), 10)).agg(F.count("*").alias("n")).collect()]
    assert len(n) == 10 and min(n) > 70 and max(n) < 130


def test_bucket_and_flush(spark):
    b = limits.Bucket(10, 1.0, 10.0, 0)
    assert [b.take(0)[0] for _ in range(11)] == [True] * 10 + [False]
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 5000, 12_000, 40_000))] + [(2, 9, 1)], "key long, seq long, ms long")
    got = {(r.key, r.fire_ms): r.writes for r in limits.flush_windows(e).collect()}
    assert got == {(1, 10_000): 2, (1, 20_000): 1, (1, 50_000): 1, (2, 10_001): 1}


def test_knn_properties(spark):
    r = np.random.default_rng(0)
    x = [(i, [float(v) for v in r.normal(size=8)]) for i in range(300)]
    v = spark.createDataFrame([*x, (300, [0.0] * 8), (301, None), (302, [1.0])], "id long, vector array<double>")
    q = v.where("id < 20").select(F.col("id").alias("qid"), "vector")
    got = knn.knn(v, q, 5).collect()
    a = np.array([p for _, p in x])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    for i in range(20):
        assert [g.id for g in sorted((g for g in got if g.qid == i), key=lambda g: g.rank)] == np.argsort(1 - a @ a[i], kind="stable")[:5].tolist()
    with pytest.raises(ValueError, match="k must"):
        knn.knn(v, q, 0)


def test_merge_shards(spark):
    rows = [(0, 1, 1, 0.1), (0, 1, 2, 0.3), (1, 1, 3, 0.2), (1, 1, 1, 0.5)]
    got = knn.merge_shards(spark.createDataFrame(rows, "shard int, qid long, id long, distance double"), 3).orderBy("rank").collect()
    assert [(g.id, g.distance) for g in got] == [(1, 0.1), (3, 0.2), (2, 0.3)]


def test_recall(spark):
    r = np.random.default_rng(1)
    x = [(i, [float(v) for v in r.normal(size=16)], i % 8) for i in range(600)]
    v = spark.createDataFrame(x, "id long, vector array<double>, label int")
    q = [(1000 + i, [float(v) for v in r.normal(size=16)]) for i in range(20)]
    qs = spark.createDataFrame(q, "qid long, vector array<double>")
    exact = {(g.qid, g.id) for g in knn.knn(v, qs).collect()}
    for found, least in ((hnsw.search(hnsw.build(v.select("id", "vector"), shards=2), qs, shards=2), 0.95), (ann.lsh_search(v, qs, 16, tables=24, bits=3), 0.9), (ann.ivf_search(v, qs, ann.centroids_of(v, 16), probes=7), 0.9)):
        assert len(exact & {(g.qid, g.id) for g in found.collect()}) >= least * len(exact)
    e = hnsw.edges(hnsw.build(v.select("id", "vector"), shards=2)).collect()
    assert all(g.src != g.dst for g in e)


@pytest.mark.parametrize("name", ["ivf_search", "lsh_search"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_registered_queries(spark, name, sf):
    """As registered, on their own table, against brute force."""
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x[ids % 20 == 0] @ x.T), axis=1, kind="stable")[:, :10]
    exact = {(int(q), int(i)) for q, row in zip(ids[ids % 20 == 0], ids[near], strict=True) for i in row}
    got = {(r.qid, r.id) for r in __spark_entry__.queries()[name](spark, path).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_state_and_snapshots(spark, tmp_path):
    state = spark.createDataFrame([(1, False), (2, True)], "id long, deleted boolean")
    got = store.apply_flags(state, spark.createDataFrame([(1,), (2,), (3,)], "id long"), True).collect()
    assert {r.id: r.outcome for r in got} == {1: "deleted", 2: "already_deleted", 3: "not_found"}
    path = str(tmp_path / "index")
    assert tables.load_snapshot(spark, path, "id long, deleted boolean").count() == 0
    tables.save_snapshot(state, path, 1)
    tables.save_snapshot(state.where("id = 1"), path, 2)
    assert tables.load_snapshot(spark, path, "id long, deleted boolean").count() == 1


def test_streamed_bucket(spark, tmp_path):
    spark.createDataFrame([(1, i, 0) for i in range(7)] + [(2, 50, 0)], "key long, seq long, ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, ms long").parquet(str(tmp_path / "in"))
    q = flows.token_bucket(stream, 5, 1.0).writeStream.format("memory").queryName("buckets").outputMode("append").start()
    for _ in range(60):  # with processing-time timeouts a query never runs out of batches
        if spark.table("buckets").count() >= 8:
            break
        time.sleep(1)
    q.stop()
    got = spark.table("buckets").collect()
    assert sum(r.allowed for r in got if r.key == 1) == 5 and all(r.retry_after == 1 for r in got if not r.allowed)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
