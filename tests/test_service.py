"""The service's verbs: bodies, filters, snapshots, stored graphs, the client."""

import pytest
from pyspark.sql import functions as F

from farspan.client import Client
from farspan.functions import requests as R
from farspan.functions import validation as V
from farspan.operators import hnsw, service
from farspan.sources import tables
from farspan.streaming import flows


def test_bodies(spark):
    rows = [('{"vector":[1,2],"k":3}', None), ('{"vector":[],"k":3}', "vector: empty"), ('{"vector":[1],"k":"x"}', "k: not a whole number"), ('{"vector":[1],"k":0}', "k: too small"), ('{"k":1}', "vector: empty"), ('{"vector":[1]}', None)]
    df = spark.createDataFrame(rows, "body string, want string")
    assert all(r.want == r.got for r in df.select("want", V.search_error(F.col("body")).alias("got")).collect())
    rows = [('{"id":"a","vector":[1]}', None), ('{"id":"","vector":[]}', "id: empty"), ('{"id":"a","vector":[],"metadata":3}', "vector: empty"), ('{"id":"a","vector":[1],"metadata":[3]}', "metadata: not an object"), ("{oops", "not JSON"), ('{"id":"a","vector":[1],"metadata":{"x":"' + "y" * 33_000 + '"}}', "metadata: too large")]
    df = spark.createDataFrame(rows, "body string, want string")
    assert all(r.want == r.got for r in df.select("want", V.insert_error(F.col("body")).alias("got")).collect())
    got = spark.createDataFrame([(0, None), (100, None), (101, None), (5, 2)], "n long, bad long").select(V.batch_error(F.col("n"), F.col("bad")).alias("e")).collect()
    assert [r.e for r in got] == ["empty", None, "too many", "item 2"]


def test_filters(spark):
    df = spark.createDataFrame([('{"price":5,"user":"a","on":true}',), ('{"price":200,"user":"a"}',), ('{"user":"b"}',), (None,)], "m string")
    count = lambda f: df.where(service.metadata_filter(f, F.col("m"))).count()
    assert [count('{"price":{"lt":100}}'), count('{"user":"a"}'), count('{"price":{"gt":5,"lte":200},"user":"a"}'), count('{"on":true}'), count("{}")] == [1, 2, 1, 1, 4]
    with pytest.raises(ValueError, match="unknown"):
        count('{"a":{"like":1}}')


def test_stored_graph(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(3)
    x = [(i, [float(v) for v in r.normal(size=8)], i % 5 == 0) for i in range(200)]
    v = spark.createDataFrame(x, "id long, vector array<double>, deleted boolean")
    tables.save_snapshot(hnsw.build(v, shards=2), str(tmp_path / "graph"), 1)
    graph = tables.load_snapshot(spark, str(tmp_path / "graph"), hnsw.GRAPH)
    q = v.where("id < 10").select(F.col("id").alias("qid"), "vector")
    got = hnsw.search(graph, q, 5, shards=2).collect()
    a = np.array([p for _, p, _ in x])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    live = np.array([i for i, _, gone in x if not gone])
    for i in range(10):
        assert [g.id for g in sorted((g for g in got if g.qid == i), key=lambda g: g.rank)] == live[np.argsort(1 - a[live] @ a[i], kind="stable")[:5]].tolist()
    assert hnsw.search(graph.where("false"), q).count() == 0
    with pytest.raises(Exception, match="another dimension"):
        hnsw.search(graph, spark.createDataFrame([(0, [1.0])], "qid long, vector array<double>")).collect()


def test_snapshots_without_an_end_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.save_snapshot(spark.range(3), path, 1)
    (tmp_path / "s" / "version=0000000002").mkdir()
    assert tables.load_snapshot(spark, path, "id long").count() == 3


def test_client(spark, tmp_path):
    c = Client(spark, str(tmp_path / "index"), 3)
    assert c.health() == {"status": "ok"} and c.search([1.0, 0.0, 0.0]) == []
    errors = c.insert([("a", [1, 0, 0], {"price": 5}), ("b", [0, 1, 0], {"price": 50}), ("a", [2, 0, 0], {"price": 7}), ("bad id!", [1, 0, 0], None), ("c", [1], None)])
    assert {r.id for r in errors.collect()} == {"bad id!", "c"}
    assert c.get("a")["metadata"] == '{"price": 7}' and c.get("zz") is None
    assert [r["id"] for r in c.search([1.0, 0.1, 0.0])] == ["a", "b"]
    assert [r["id"] for r in c.search([1.0, 0.1, 0.0], filters={"price": {"gt": 10}})] == ["b"]
    assert [c.delete("a"), c.delete("a"), c.delete("zz")] == ["deleted", "already_deleted", "not_found"]
    assert c.get("a") is None and c.stats()["num_deleted"] == 1
    with pytest.raises(ValueError, match="dimension"):
        c.search([1.0])


def test_streams_and_sinks(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:00:01", 200, 5.0), ("2024-01-01 00:00:02", 500, 15.0)], "ts string, status int, duration_ms double").select(F.col("ts").cast("timestamp").alias("ts"), "status", "duration_ms")
    tables.append_requests(e, str(tmp_path / "requests"))
    tables.append_requests(e, str(tmp_path / "requests"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "requests"))
    q = flows.request_metrics(stream).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.requests, r.errors, r.avg_ms) for r in spark.table("metrics").collect()] == [(4, 2, 10.0)]
    q = flows.batched_writes(stream, str(tmp_path / "out"), str(tmp_path / "check"), every="1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    got = spark.range(1).select(R.elapsed_ms(F.lit(7), F.lit(3)).alias("e"), R.uptime_seconds(F.lit(2500), F.lit(None)).alias("u")).first()
    assert (got.e, got.u) == (4, 0)
