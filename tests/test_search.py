"""Searches that compare within tasks, on odd rows, against plain numpy and their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from farspan.functions import distance as D
from farspan.operators import ann, hnsw, knn
from farspan.plans import service_queries

SEARCHES = {
    "lsh": lambda v, q: ann.lsh_search(v, q, 8),
    "ivf": lambda v, q: ann.ivf_search(v, q, ann.centroids_of(v.where("size(vector) = 8"), 8)),
}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)], i % 4) for i in range(400)]
    rows += [rows[7], (7, [2 * x for x in rows[7][1]], 3), (500, [0.0] * 8, 1), (501, None, 1), (502, [1.0], 1), (503, [1.0] * 7 + [None], None), (None, [1.0] * 8, 2), (504, [1.0] * 8, None)]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(5)


@pytest.mark.parametrize("name", SEARCHES)
def test_approximate_search_on_odd_rows(spark, name):
    """What is found is ranked as all pairs are, without undefined distances, and no pair is a row of a join."""
    rows, v = odd(spark)
    q = v.where("id % 20 = 0 or id in (501, 502, 504)").select(F.col("id").alias("qid"), "vector").union(v.where("id = 7").select("id", "vector"))
    found = SEARCHES[name](v, q)
    assert "Join" not in plan(found)
    got = {}
    for g in found.collect():
        got.setdefault(g.qid, []).append((g.rank, g.distance, g.id))
    whole = {(i, tuple(x)) for i, x, _ in rows if i is not None and x is not None and len(x) == 8 and None not in x and any(x)}
    assert set(got) == {i for i, _ in whole if i % 20 == 0 and i != 500 or i in (7, 504)}
    right = 0
    for qid, own in got.items():
        own.sort()
        assert [rank for rank, _, _ in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        a = np.array([x for i, x in whole if i == qid][0])
        exact = sorted({(round(float(1 - a @ np.array(x) / np.linalg.norm(a) / np.linalg.norm(x)), 9), i) for i, x in whole})
        assert len({(d, i) for _, d, i in own}) == 10 and {(d, i) for _, d, i in own} <= {(abs(round(d, 6)), i) for d, i in exact}
        right += len({i for _, _, i in own} & {i for _, i in exact[:10]})
    assert right >= 0.8 * 10 * len(got)


@pytest.mark.parametrize("name", SEARCHES)
def test_approximate_search_of_nothing(spark, name):
    _, v = odd(spark)
    q = v.where("id = 20").select(F.col("id").alias("qid"), "vector")
    none = v.where("false")
    assert SEARCHES[name](none, q).count() == 0 and SEARCHES[name](v, q.where("false")).count() == 0


def test_best_are_kept_over_steps():
    """Batches in any order, ties and repeated ids: the same as all at once."""
    r = np.random.default_rng(2)
    d, ids = r.integers(0, 12, (6, 700)) / 10, r.integers(0, 90, 700)
    d[0, :695], d[1] = np.nan, np.inf
    for once in (False, True):
        best_d, best_i = np.full((6, 10), np.inf), np.zeros((6, 10), np.int64)
        for at in range(0, 700, 70):
            for rows in (np.array([0, 2, 4]), np.array([1, 3, 5])):
                knn.keep_best(best_d, best_i, rows, d[rows, at : at + 70], ids[at : at + 70], once)
        for i in range(6):
            pairs = [(x, int(y)) for x, y in zip(d[i], ids, strict=True) if np.isfinite(x)]
            want = sorted(set(pairs) if once else pairs)[:10]
            assert [(x, int(y)) for x, y in zip(best_d[i], best_i[i], strict=True) if np.isfinite(x)] == want


def oracle(path, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    return sorted(c.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_shards_merge_by_the_distance_that_ranks(spark, tmp_path):
    """Distances that are the same as shown, at six digits, but not at nine."""
    angle = lambda q, i: 0.1 * q + (1e-3 * (1 + 0.002 * (15 - i)) if i else 0)
    rows = [(20 * q + i, [math.cos(angle(q, i)), math.sin(angle(q, i))], 0) for q in range(3) for i in range(15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = __spark_entry__.queries()["shard_merge_topk"](spark, str(tmp_path)).collect()
    assert [(g.qid, g.id, g.rank) for g in sorted(got)] == [(q, i, rank) for q, i, _, rank in oracle(tmp_path, "shard_merge_topk")]


def test_results_round_as_their_sql(spark):
    """Halves at six digits, which are seldom halves in binary."""
    x = [s * round((2 * i + 1) * 5e-7, 9) for i in range(20_000) for s in (1, -1)] + [0.0, -1e-9, 2.5, 1e300, float("inf")]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(D.shown(F.col("x")).alias("y")).collect()]
    assert got == [y for (y,) in duckdb.execute("SELECT round(v, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [x]).fetchall()]


def test_graph_shards_keep_their_size(spark, tmp_path, monkeypatch):
    """More vectors, more shards, not larger ones."""
    spark.range(9000).selectExpr("id AS vec_id", "array(float(id % 97 + 1), float(id % 89)) AS embedding", "0 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    shards = []
    build = hnsw.build
    monkeypatch.setattr(service_queries.hnsw, "build", lambda v, **how: shards.append(how["shards"]) or build(v, **how))
    __spark_entry__.queries()["hnsw_recall"](spark, str(tmp_path))
    assert shards == [3]


def test_graph_distances_are_those_of_all_pairs():
    x = np.random.default_rng(4).normal(size=(50, 8))
    x[9] = 0
    for metric in knn.METRICS:
        g = hnsw.Graph(metric, hnsw.PRESETS["default"])
        g.x = x
        for nodes in ([3, 1, 4], [9, 2]):
            want = np.round(knn.distances(x[nodes], x[:1], metric)[0], 9)
            assert np.array_equal(g._to(x[0], nodes), want, equal_nan=True)
