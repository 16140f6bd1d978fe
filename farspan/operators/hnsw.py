"""Navigable small-world graphs, one for each shard, built and searched inside grouped tasks.

The build follows the published algorithm (Malkov and Yashunin, algorithm 1 with simple neighbour selection): levels
come from the key's MD5, links are made for layers up to the lower of the node's and the entry's level, and a higher
node then becomes the entry. Insertion order is by id, so a shard's graph is reproducible. Shard size bounds a task.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import shown
from ..functions.requests import shard_of
from .knn import TIE_DIGITS, distances


@dataclass(frozen=True)
class Config:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100

    def __post_init__(self):
        if self.m < 2:
            raise ValueError("m must be 2 or more")

    @property
    def m0(self) -> int:
        return 2 * self.m


#: Fixed presets.
PRESETS = {"fast": Config(8, 100, 50), "default": Config(16, 200, 100), "high_quality": Config(32, 400, 200)}


def level(key, m: int, top: int = 10) -> int:
    u = (int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    return min(top, math.floor(-math.log(u) / math.log(m)))


class Graph:
    def __init__(self, metric: str, config: Config):
        self.metric, self.config = metric, config
        self.ids: list[int] = []
        self.x = np.zeros((0, 0))
        self.links: list[list[list[int]]] = []
        self.entry = -1
        self.norms: np.ndarray | None = None  # of x, taken once

    def _to(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        if self.metric != "cosine":
            return np.round(distances(self.x[nodes], q[None], self.metric)[0], TIE_DIGITS)
        if self.norms is None:
            self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        n = self.norms[nodes] * math.sqrt(q @ q)
        if not n.all():
            return np.round(distances(self.x[nodes], q[None], self.metric)[0], TIE_DIGITS)
        return np.round(1 - self.x[nodes] @ q / n, TIE_DIGITS)

    def search_layer(self, q: np.ndarray, entries: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        seen = set(entries)
        near = [(d, n) for d, n in zip(self._to(q, entries).tolist(), entries, strict=True)]
        best = [(-d, -n) for d, n in near]
        heapq.heapify(near), heapq.heapify(best)
        while near:
            d, n = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [v for v in self.links[n][layer] if v not in seen] if layer < len(self.links[n]) else []
            if not fresh:
                continue
            seen.update(fresh)
            for e, v in zip(self._to(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(near, (e, v))
                    heapq.heappush(best, (-e, -v))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def build(self, ids: list[int], x: np.ndarray) -> Graph:
        self.ids, self.x = ids, x
        c = self.config
        for n, key in enumerate(ids):
            own = level(key, c.m)
            self.links.append([[] for _ in range(own + 1)])
            if self.entry < 0:
                self.entry = n
                continue
            top, at = len(self.links[self.entry]) - 1, [self.entry]
            for layer in range(top, own, -1):
                at = [self.search_layer(x[n], at, 1, layer)[0][1]]
            for layer in range(min(own, top), -1, -1):
                found = self.search_layer(x[n], at, c.ef_construction, layer)
                most = c.m0 if layer == 0 else c.m
                self.links[n][layer] = [v for _, v in found[: c.m]]
                for v in self.links[n][layer]:
                    theirs = self.links[v][layer]
                    theirs.append(n)
                    if len(theirs) > most:
                        d = self._to(x[v], theirs)
                        self.links[v][layer] = [theirs[i] for i in np.lexsort((theirs, d))[:most]]
                at = [v for _, v in found]
            if own > top:
                self.entry = n
        return self

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            at = [self.search_layer(q, at, 1, layer)[0][1]]
        found = self.search_layer(q, at, max(ef, k), 0)
        return sorted((d, self.ids[n]) for d, n in found)[:k]


def _graph(rows: pd.DataFrame, metric: str, config: Config) -> Graph:
    rows = rows.sort_values("id").drop_duplicates("id", keep="last")
    return Graph(metric, config).build(rows["id"].tolist(), np.array(rows["vector"].tolist(), np.float64))


GRAPH = "shard int, id long, vector array<double>, deleted boolean, level int, links array<array<long>>"


def build(vectors: DataFrame, metric: str = "cosine", config: Config = PRESETS["default"], shards: int = 4) -> DataFrame:
    """vectors (id, vector, and maybe deleted) to one row a node (GRAPH): a table that can be written, read and searched
    without building again. links: the ids that the node is linked with, layer by layer. A dimension that differs
    within the table is an error."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["vector"].map(len).nunique() > 1:
            raise ValueError("vectors of unlike dimensions")
        rows = rows.sort_values("id").drop_duplicates("id", keep="last")
        g = Graph(metric, config).build(rows["id"].tolist(), np.array(rows["vector"].tolist(), np.float64))
        links = [[[g.ids[v] for v in layer] for layer in own] for own in g.links]
        return pd.DataFrame({"shard": rows["shard"].to_numpy(), "id": g.ids, "vector": list(g.x), "deleted": rows["deleted"].to_numpy(), "level": [len(x) - 1 for x in links], "links": links})

    deleted = F.col("deleted") if "deleted" in vectors.columns else F.lit(False)
    plain = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(deleted, F.lit(False)).alias("deleted"))
    return plain.where("id is not null and vector is not null").withColumn("shard", shard_of(F.col("id"), shards)).groupBy("shard").applyInPandas(run, GRAPH)


def _graph(rows: pd.DataFrame, metric: str, config: Config) -> Graph:
    rows = rows.sort_values("id")
    g = Graph(metric, config)
    g.ids, g.x = rows["id"].tolist(), np.array(rows["vector"].tolist(), np.float64)
    at = {key: i for i, key in enumerate(g.ids)}
    g.links = [[[at[v] for v in layer] for layer in own] for own in rows["links"]]
    top = rows["level"].max()  # the first node of the highest level became the entry
    g.entry = int(np.flatnonzero(rows["level"].to_numpy() == top)[0])
    return g


def search(graph: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", config: Config = PRESETS["default"], shards: int = 4) -> DataFrame:
    """A graph table of so many shards and queries (qid, vector) to (qid, rank, id, distance, score), merged over shards.
    Each shard's task gets the queries as rows. Deleted nodes lead the way but aren't found: a shard is searched for as many more as
    it has deleted ones, up to twice ef. An empty graph finds nothing; a query of another dimension is an error."""

    def run(key: tuple, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(asked):
            g = _graph(nodes, metric, config)
            gone = set(nodes.loc[nodes["deleted"], "id"])
            ef = max(config.ef_search, k) + min(len(gone), config.ef_search)
            for q, v in zip(asked["qid"], asked["vector"], strict=True):
                if len(v) != g.x.shape[1]:
                    raise ValueError("a query of another dimension")
                found = [(d, i) for d, i in g.search(np.array(v, np.float64), ef, ef) if i not in gone]
                out += [(q, i, d) for d, i in found[:k]]
        return pd.DataFrame(out, columns=["qid", "id", "d"]).astype({"qid": "int64", "id": "int64", "d": "float64"})

    everywhere = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))  # the stated queries, once for each shard
    near = graph.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInPandas(run, "qid long, id long, d double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", shown(F.col("d")).alias("distance"), shown(1 - F.col("d")).alias("score"))


def edges(graph: DataFrame) -> DataFrame:
    """The graph's directed links: (shard, layer, src, dst)."""
    layers = graph.select("shard", F.col("id").alias("src"), F.posexplode("links").alias("layer", "to"))
    return layers.select(F.col("shard").cast("long").alias("shard"), F.col("layer").cast("long").alias("layer"), "src", F.explode("to").alias("dst"))
