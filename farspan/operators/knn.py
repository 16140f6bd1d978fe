"""Exact k-nearest-neighbour search: blocks of queries against all vectors, local top-k before one small shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import shown

#: Queries that one broadcast block has, at most.
BLOCK = 4096
#: Vectors that are compared with a block at once.
STEP = 512
#: Distances count as ties when they agree to so many digits.
TIE_DIGITS = 9
#: Numbers that a block of differences may hold.
HELD = 1 << 22
METRICS = ("cosine", "euclidean", "dotproduct")


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """queries x vectors, double; NaN where the cosine of a zero vector would be asked for."""
    if metric == "euclidean":
        step = max(1, HELD // max(1, x.size))  # queries whose differences are held together
        return np.concatenate([np.sqrt(((q[i : i + step, None, :] - x[None]) ** 2).sum(axis=2)) for i in range(0, len(q), step)] or [np.zeros((0, len(x)))])
    product = q @ x.T
    if metric == "dotproduct":
        return -product
    n = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None]
    with np.errstate(all="ignore"):
        return np.where(n > 0, 1 - product / n, np.nan)


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's vectors that have this dimension and no nulls, and these vectors in double precision."""
    ok = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), dimension)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(axis=1)
        ok, x = ok[whole], x[whole]
    return ok, x


def keep_best(best_d: np.ndarray, best_i: np.ndarray, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, once: bool = False) -> None:
    """Offers distances d (rows x ids) to these rows of the best (queries x k, least (d, id) first, inf where there is
    none), in place. What isn't finite is no offer. once: an id counts once at one distance."""
    k = best_d.shape[1]
    most = best_d[rows, -1:]
    if d.shape[1] > k and np.isinf(most).any() and not (once and len(np.unique(ids)) < len(ids)):
        most = np.minimum(most, np.partition(np.where(np.isfinite(d), d, np.inf), k - 1, axis=1)[:, k - 1 : k])
    row, col = np.nonzero((d <= most) & np.isfinite(d))  # few, once there are k
    if not len(row):
        return
    near = np.unique(row)
    own = rows[near]
    r, e, i = np.concatenate([np.repeat(near, k), row]), np.concatenate([best_d[own].ravel(), d[row, col]]), np.concatenate([best_i[own].ravel(), ids[col]])
    order = np.lexsort((i, e, r))
    order = order[np.isfinite(e[order])]
    r, e, i = r[order], e[order], i[order]
    if once:
        new = np.r_[True, (r[1:] != r[:-1]) | (e[1:] != e[:-1]) | (i[1:] != i[:-1])]
        r, e, i = r[new], e[new], i[new]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    r, e, i, place = (y[place < k] for y in (r, e, i, place))
    best_d[own] = np.inf
    best_d[rows[r], place], best_i[rows[r], place] = e, i


#: From a block of queries to what gives, for some vectors, the (rows of queries, places of vectors, which pairs or None
#: for all) that are to be compared.
Lead = Callable[[np.ndarray], Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]]


def everywhere(q: np.ndarray):
    rows = np.arange(len(q))
    return lambda x: ((rows, cols, None) for cols in steps(np.arange(len(x))))


def steps(places: np.ndarray) -> list[np.ndarray]:
    return [places[at : at + STEP] for at in range(0, len(places), STEP)]


def candidates(vectors: DataFrame, queries: DataFrame, k: int, metric: str, lead: Lead = everywhere, drop_self: bool = False, once: bool = False) -> DataFrame:
    """(qid, id, d): the k best that each task finds for each query among the pairs that `lead` lets meet."""
    spark, parts = vectors.sparkSession, []
    ids, block = [], []

    def search(ids: list[int], block: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(block, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best_d, best_i = np.full((len(qid), k), np.inf), np.zeros((len(qid), k), np.int64)
            met = lead(q)
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                ok, x = matrix(batch.column(1), q.shape[1])
                own = batch.column(0).to_numpy(zero_copy_only=False)[ok]
                for rows, cols, pairs in met(x):
                    d = np.round(distances(x[cols], q[rows], metric), TIE_DIGITS)
                    if pairs is not None:
                        d[~pairs] = np.inf
                    if drop_self:
                        d[qid[rows][:, None] == own[cols][None]] = np.inf
                    keep_best(best_d, best_i, rows, d, own[cols], once)
            hit = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(qid[np.nonzero(hit)[0]]), pa.array(best_i[hit]), pa.array(best_d[hit])], ["qid", "id", "d"])

        return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "qid long, id long, d double")

    for row in queries.select(F.col("qid").cast("long").alias("qid"), "vector").where("qid is not null and vector is not null").toLocalIterator():
        ids.append(row.qid)
        block.append(row.vector)
        if len(ids) == BLOCK:
            parts.append(search(ids, block))
            ids, block = [], []
    if ids or not parts:
        parts.append(search(ids, block) if ids else spark.createDataFrame([], "qid long, id long, d double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(qid, id, d) to the k best of each query by (d, id), as (qid, rank, id, d)."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", "d")


def results(best: DataFrame) -> DataFrame:
    return best.select("qid", "rank", "id", shown(F.col("d")).alias("distance"), shown(1 - F.col("d")).alias("score"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str | None = None, drop_self: bool = False) -> DataFrame:
    """vectors (id, vector), queries (qid, vector) to (qid, rank, id, distance, score), ordered by (distance, id).

    Queries go out in blocks of BLOCK rows, so a broadcast has a fixed size whatever their number. Each task keeps its
    own k best of each query; a window over k rows a task and query gives the result. Null vectors, vectors of another
    dimension and undefined distances are left out.
    """
    return results(nearest(vectors, queries, k, metric, drop_self))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str | None = None, drop_self: bool = False) -> DataFrame:
    """As knn, with the distance that ranks: (qid, rank, id, d)."""
    metric = metric or "cosine"
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if not 1 <= k <= 1000:
        raise ValueError("k must be 1 to 1000")
    return ranked(candidates(vectors, queries, k, metric, drop_self=drop_self), k)


def page(results: DataFrame, offset: int, size: int) -> DataFrame:
    return results.where(F.col("rank").between(offset + 1, offset + size))


def merge_shards(results: DataFrame, k: int) -> DataFrame:
    """(shard, qid, id, distance) of several shards to the k best distinct ids of each query."""
    best = results.groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
