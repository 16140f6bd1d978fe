"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, hashed; each also counts a second and third occurrence. The
score is a logistic function of a linear part and of pairwise interactions of learned term factors, so that two terms
together (an insult with a group) can weigh otherwise than either alone.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_free_name, lean, prepare, staged_with, texts_of

SPACE, TERMS, FACTORS = 1 << 20, 1024, 6
#: Labelled rows that the model is fitted on, at most (chosen by a hash of the id).
MAX_FIT = 12_000
#: Words whose terms a worker holds.
HELD_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)


@dataclass
class Model:
    index: dict[int, int]  # hashed term to parameter
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def word_terms(word: str) -> list[int]:
    return [zlib.crc32(w.encode()) % SPACE for w in (word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k))]


class Terms(dict):
    """Word to its terms (or only those of `known`), as far as held."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= HELD_WORDS:
            self.clear()
        own = word_terms(word)
        got = self[word] = tuple(own if self.known is None else (h for h in own if h in self.known))
        return got

    def of(self, text: bytes) -> set[int]:
        """Distinct terms; the second and third occurrence of a term are terms of their own."""
        count: Counter[int] = Counter()
        for own in map(self.__getitem__, WORD.findall(text.decode().lower())):
            if own:
                count.update(own)
        return {h + SPACE * i for h, n in count.items() for i in range(min(n, 3))}


class KnownTerms(Terms):
    """Of a fitted model: only words with a known base term count."""

    def __init__(self, model: Model):
        super().__init__({h % SPACE: 1 for h in model.index})


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, terms: list[int]) -> Model | None:
    """x: rows by terms, 0 or 1 (float32); y: 0 or 1. Learns by Adam."""
    n, p = len(y), float(y.mean()) if len(y) else 0.0
    if not len(terms) or not 0 < p < 1:
        return None
    rng = np.random.default_rng(11)
    params = [np.float32([np.log(p / (1 - p))]), np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32)]
    seen, pos = x.sum(axis=0), x[y > 0].sum(axis=0)
    params[1][:] = np.clip(np.log((pos + 0.5 * p * 4) / (seen * p + 2 * p)), -1, 3) * 0.3
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for step in range(1, 121):
        b, w, v = params
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        d = ((_sigmoid(z) - y) / n).astype(np.float32)
        xd = x.T @ d
        grads = [np.float32([d.sum()]), xd + 2e-4 * w, x.T @ (d[:, None] * xv) - v * xd[:, None] + 1e-3 * v]
        for q, g, m1, m2 in zip(params, grads, first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            q -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    return Model({t: i for i, t in enumerate(terms)}, float(params[0][0]), params[1].astype(float), params[2].astype(float))


def score(terms: set[int], model: Model) -> float:
    at = sorted(model.index[t] for t in terms if t in model.index)
    v = model.factors[at]
    s = v.sum(axis=0)
    return float(_sigmoid(model.bias + model.linear[at].sum() + 0.5 * ((s * s).sum() - (v * v).sum())))


def _telling(counts: DataFrame, n: int, toxic: int) -> list[int]:
    """The TERMS terms of counts (term, seen, pos) that tell most about n rows, toxic of which are: by G-statistic."""
    p, seen, pos = toxic / n, F.col("seen"), F.col("pos")

    def part(a, e):
        return F.when(a > 0, a * F.log(a / e)).otherwise(0.0)

    gain = part(pos, seen * p) + part(seen - pos, seen * (1 - p)) + part(toxic - pos, (n - seen) * p + 1e-9) + part(n - seen - toxic + pos, (n - seen) * (1 - p) + 1e-9)
    told = counts.where(seen >= max(3, n // 3000)).select("term", F.round(gain, 6).alias("gain")).where("gain > 0")
    return [r.term for r in told.orderBy(F.desc("gain"), "term").limit(TERMS).collect()]


def learn(docs: DataFrame, labels: DataFrame, may_learn, max_fit: int = MAX_FIT) -> Model | None:
    """A model from about max_fit labelled rows where may_learn (a column over doc_id) holds.

    The labels chosen are at most 1.2 * max_fit + 500 narrow rows, so they are broadcast; a doc_id labelled more than
    once counts as toxic if any of its labels is. The rows' terms are written; terms are counted and chosen by
    aggregation, and one task learns from a bit for each row and chosen term. The driver gets terms and model only.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(may_learn)
    n, scale = known.count(), 1 << 30
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(scale)) < int(min(1.0, max_fit / max(n, 1)) * scale))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).limit(int(1.2 * max_fit) + 500)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            own = [np.array(sorted(terms.of(t)), np.int32) for t in texts_of(batch)]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*own, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "terms"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows, seen = staged_with(chosen.select("toxic", "text").mapInArrow(lean(terms_of), "toxic int, terms array<int>"), "terms", n=F.count(F.lit(1)), toxic=F.sum("toxic"))
    if not 0 < (seen["toxic"] or 0) < seen["n"]:
        return None
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("toxic").alias("pos"))
    best = _telling(counts, seen["n"], seen["toxic"])
    at = np.array(sorted(best), np.int32)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.packbits(np.isin(at, np.array(t, np.int32), assume_unique=True)).tobytes() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.binary())], ["toxic", "bits"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((y, x) for batch in batches for y, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        x = np.unpackbits(np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(len(found), -1), axis=1, count=len(at)).astype(np.float32)
        model = fit(x, np.array([y for y, _ in found], np.float32), at.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = rows.mapInArrow(lean(bits), "toxic int, bits binary").repartition(1).mapInArrow(lean(solve), "model binary").collect()  # TERMS bits a row
    return pickle.loads(fitted[0].model) if fitted and best else None


def with_score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a double column, 0 to 1, named `_toxicity` unless docs has such a column, whatever its case: then with as
    many further _ as make it new (`common.column_free_name` tells the name).

    Null, empty and very long texts are scored like any other, whole (no terms: the bias alone); with no model (no
    labels, or one kind only) every score is 0. Rows that repeat score alike, so equal texts tie; other columns pass;
    an empty table gives none.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms at most

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        m = shared.value
        if m is None:
            return pa.array([0.0] * len(text), pa.float64())
        terms = known_terms(m)
        return pa.array([score(terms.of(t or b""), m) for t in text.cast(pa.binary()).to_pylist()], pa.float64())

    return docs.withColumn(column_free_name(docs, "_toxicity"), run(F.col("text").cast("string")))


_KNOWN: list[tuple[Model, KnownTerms]] = []


def known_terms(model: Model) -> KnownTerms:
    """Of this very model: a worker that is used again meets other models."""
    if not _KNOWN or _KNOWN[0][0] is not model:
        _KNOWN[:] = [(model, KnownTerms(model))]
    return _KNOWN[0][1]
