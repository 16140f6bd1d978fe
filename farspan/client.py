"""A client of an index that is kept as snapshots in a shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import validation as V
from .functions.requests import rebuild_advice
from .operators import knn, store
from .operators.service import metadata_filter
from .sources.tables import load_snapshot, save_snapshot

STATE = "id string, vector array<double>, metadata string, level int, deleted boolean"


class Client:
    """health, stats, search, insert, get and delete over one index. Each change writes a version."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine"):
        self.spark, self.path, self.dimension, self.metric = spark, path, dimension, metric

    def _state(self) -> DataFrame:
        return load_snapshot(self.spark, self.path, STATE)

    def _save(self, state: DataFrame) -> None:
        from .sources.tables import versions

        save_snapshot(state, self.path, 1 + max(versions(self.spark, self.path), default=0))

    def health(self) -> dict:
        return {"status": "ok"}

    def stats(self) -> dict:
        out = store.stats(self._state())
        return out.withColumn("advice", rebuild_advice(F.col("deleted_percent"))).first().asDict()

    def insert(self, rows: list[tuple[str, list[float], dict | None]]) -> DataFrame:
        """Rows (id, vector, metadata), later ones of an id win. Gives (id, error) of what was turned away."""
        from .operators.service import upsert

        asked = self.spark.createDataFrame([(i, x[0], [float(v) for v in x[1]], None if x[2] is None else json.dumps(x[2])) for i, x in enumerate(rows)], "seq long, id string, vector array<double>, metadata string")
        error = F.coalesce(V.request_error(F.col("id"), F.col("vector"), F.col("metadata")), F.when(F.size("vector") != self.dimension, "vector: other dimension"))
        new = upsert(asked.where(error.isNull()), self.dimension, self.metric)
        self._save(self._state().join(new, "id", "left_anti").select("id", "vector", "metadata", "level", "deleted").unionByName(new))
        return asked.where(error.isNotNull()).select("id", error.alias("error"))

    def get(self, id_: str) -> dict | None:
        row = store.get(self._state(), id_).select("id", "vector", "metadata").first()
        return row.asDict() if row else None

    def delete(self, id_: str) -> str:
        state = self._state()
        outcome = store.apply_flags(state, self.spark.createDataFrame([(id_,)], "id string"), True).first().outcome
        if outcome == "deleted":
            self._save(state.withColumn("deleted", F.col("deleted") | (F.col("id") == id_)))
        return outcome

    def search(self, vector: list[float], k: int | None = None, filters: dict | None = None) -> list[dict]:
        """The k (10 unless given, 100 at most) nearest, best first."""
        if len(vector) != self.dimension:
            raise ValueError("vector: other dimension")
        if k is not None and not 1 <= k <= V.MAX_K:
            raise ValueError("k: out of bounds")
        state = store.compact(self._state())
        if filters:
            state = state.where(metadata_filter(json.dumps(filters), F.col("metadata")))
        numbered = state.select("id", "vector", F.xxhash64("id").alias("number"))
        found = knn.knn(numbered.select(F.col("number").alias("id"), "vector"), self.spark.createDataFrame([(0, [float(v) for v in vector])], "qid long, vector array<double>"), min(k or 10, 100), self.metric)
        own = found.select(F.col("id").alias("number"), "distance", "score").join(numbered.select("number", "id"), "number").orderBy("distance", "id")
        return [{"id": r.id, "distance": r.distance, "score": r.score} for r in own.collect()]
