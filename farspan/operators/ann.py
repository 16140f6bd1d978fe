"""Approximate search by random hyperplanes and by an inverted file of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import normalize
from .knn import HELD, Lead, candidates, distances, matrix, ranked, results, steps


def _met(vectors: DataFrame, queries: DataFrame, dimension: int, lead: Lead, k: int) -> DataFrame:
    """The k nearest by cosine distance among the pairs that meet. Each task compares its vectors with blocks of queries
    in place and keeps its own k best, so no pair is a row. Equal (id, distance) of a query count once; null, zero and
    wrongly sized vectors and queries are left out."""
    whole = queries.where((F.size("vector") == dimension) & ~F.exists("vector", lambda x: x.isNull()))
    found = candidates(vectors, whole, k, "cosine", lead, once=True)
    return results(ranked(found.distinct(), k))


def lsh_search(vectors: DataFrame, queries: DataFrame, dimension: int, k: int = 10, tables: int = 12, bits: int = 3, seed: int = 1) -> DataFrame:
    """Sign patterns of random projections; a query meets the vectors of its own pattern in any table.

    The defaults are set for recall: on `embeddings`, without clusters, they meet 80 % of the vectors."""
    if not 1 <= bits <= 62:
        raise ValueError("bits must be 1 to 62")
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dimension))

    def keys(x: np.ndarray) -> np.ndarray:
        signs = (x @ planes.reshape(tables * bits, dimension).T >= 0).reshape(len(x), tables, bits)
        return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.min_scalar_type((1 << bits) - 1)).T.copy()

    def lead(q: np.ndarray):
        rows, asked = np.arange(len(q)), keys(q)

        def met(x: np.ndarray):
            for cols in steps(np.arange(len(x))):
                pairs = np.zeros((len(q), len(cols)), bool)
                for a, b in zip(asked, keys(x[cols]), strict=True):
                    pairs |= a[:, None] == b[None]
                yield rows, cols, pairs

        return met

    return _met(vectors, queries, dimension, lead, k)


#: Cells that a codebook may have; it goes to all tasks.
MAX_CELLS = 65_536


def codebook(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cells in order and their centres; centroids (cell, centre) are checked to be MAX_CELLS at most. Rows without a
    cell or centre are passed over."""
    book = sorted((r.cell, r.centre) for r in centroids.where("cell is not null and centre is not null").limit(MAX_CELLS + 1).collect())
    if len(book) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return np.array([c for c, _ in book], np.int64), np.array([x for _, x in book], float).reshape(len(book), len(book[0][1]) if book else 0)


def near_cells(centres: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the `most` nearest centres of each vector, nearest first, ties by place, and their distances, NaN
    where undefined."""
    step, at, near = max(1, HELD // max(1, len(centres))), [], []
    for i in range(0, len(x), step):
        d = distances(centres, x[i : i + step], "cosine")
        at.append(np.argsort(d, axis=1, kind="stable")[:, :most])
        near.append(np.take_along_axis(d, at[-1], 1))
    none = np.zeros((0, min(most, len(centres))))
    return np.concatenate([none.astype(np.int64), *at]), np.concatenate([none, *near])


def cells_of(vectors: DataFrame, key: str, centroids: DataFrame, most: int = 1) -> DataFrame:
    """(key, vector) to (key, vector, cell, cd): each vector with its `most` nearest cells by cosine distance, ties by
    cell. Nothing is shuffled. Null, zero and wrongly sized vectors have no cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebook(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = shared.value
        for batch in batches:
            ok, x = matrix(batch.column(1), centres.shape[1])
            near, d = near_cells(centres, x, most)
            row, place = np.nonzero(np.isfinite(d))
            take = pa.array(ok[row])
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cells[near[row, place]]), pa.array(d[row, place])], [*batch.schema.names, "cell", "cd"])

    own = vectors.select(key, "vector")
    schema = ", ".join(f"{c} {t}" for c, t in own.dtypes)
    return own.mapInArrow(run, f"{schema}, cell long, cd double")


def ivf_search(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """centroids (cell, centre): each vector lies in the nearest cell, a query looks into its nearest `probes` cells.

    The default is set for recall: on `embeddings`, without clusters, 8 of the 10 labels' cells are needed."""
    _, centres = codebook(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def lead(q: np.ndarray):
        centres = shared.value
        near, d = near_cells(centres, q, probes)
        row, place = np.nonzero(np.isfinite(d))
        order = np.argsort(near[row, place], kind="stable")
        row, cell = row[order], near[row, place][order]

        def met(x: np.ndarray):
            own, d = near_cells(centres, x, 1)
            cols = np.flatnonzero(np.isfinite(d).any(axis=1))
            for c in np.unique(own[cols]):
                rows = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
                if len(rows):
                    yield from ((rows, some, None) for some in steps(cols[own[cols, 0] == c]))

        return met

    return _met(vectors, queries, centres.shape[1], lead, k)


def centroids_of(labelled: DataFrame, dimension: int) -> DataFrame:
    """(label, vector) to (cell, centre): the mean of each label's unit vectors, one partial sum for each place."""
    v = labelled.withColumn("u", normalize(F.col("vector")))
    sums = v.groupBy("label").agg(*(F.avg(F.col("u")[i]).alias(f"c{i}") for i in range(dimension)))
    return sums.select(F.col("label").alias("cell"), F.array(*(f"c{i}" for i in range(dimension))).alias("centre"))
