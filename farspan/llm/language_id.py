"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a linear classifier over hashed byte trigrams is learned (ridge
regression, all bits in one solve); a text's margins are decoded to the codeword with the least loss, each bit
weighted by how well it was learned. Where the second codeword is nearly as close the row is flagged as ambiguous.
The model is fitted in one executor task, on a bounded sample; the driver gets the model alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_free_name, lean, prepare, texts_of

BUCKETS, BITS = 4096, 15
#: Labelled rows that the model is fitted on, at most (chosen by a hash of the id).
MAX_FIT = 4000
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")
NONE = "und"


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit, and the bias in the last row
    trust: np.ndarray  # of each bit, sums to 1
    sharp: float


def features(text: bytes) -> np.ndarray:
    """Root counts of hashed trigrams of letters and gaps, at unit length; in blocks, whatever the text's length."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), 1 << 20):
        x = np.frombuffer(b" " * (at == 0) + text[max(0, at - 2) : at + (1 << 20)].translate(FOLDED) + b" ", np.uint8).astype(np.uint32)
        if len(x) > 2:
            h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
            h = np.where((x[:-2] == 32) & (x[1:-1] == 32), np.uint32(0), h) >> np.uint32(20)
            counts += np.bincount(h, minlength=BUCKETS)
    counts[0] = 0
    counts = np.sqrt(counts)
    return counts / (np.sqrt(counts @ counts) or 1.0)


def codewords(languages: int, bits: int = BITS, tries: int = 200) -> np.ndarray:
    """The code with the greatest least distance among seeded random ones; every column splits the languages."""
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(tries):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        for j in np.flatnonzero(abs(code.sum(axis=0)) == languages):
            code[rng.integers(languages), j] *= -1
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(languages, dtype=bool)].min() if languages > 1 else bits
        if least > most:
            best, most = code, least
    return best


def fit(x: np.ndarray, labels: list[str]) -> Model | None:
    """None without labelled rows."""
    names = sorted(set(labels))
    if not names:
        return None
    codes = codewords(len(names))
    y = codes[[names.index(v) for v in labels]]
    tune = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    a = np.ones((int((~tune).sum()), x.shape[1] + 1), x.dtype)  # the bias in the last column
    a[:, :-1] = x[~tune]
    b = y[~tune].astype(x.dtype)
    if len(a) < a.shape[1]:  # the smaller of the two equal forms
        gram = a @ a.T
        gram[np.diag_indices(len(gram))] += x.dtype.type(0.3)
        w = a.T @ np.linalg.solve(gram, b)
    else:
        gram = a.T @ a
        gram[np.diag_indices(len(gram))] += x.dtype.type(0.3)
        w = np.linalg.solve(gram, a.T @ b)
    held = tune if tune.any() else ~tune
    right = (np.sign(x[held] @ w[:-1] + w[-1]) == y[held]).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.05)
    return Model(names, codes, w.astype(np.float64), trust / trust.sum(), 6.0)


def decode(margins: np.ndarray, model: Model) -> tuple[int, float, float]:
    """The language with the least weighted loss, its share of exp(-loss), and its lead over the second."""
    loss = (np.maximum(0.0, 1 - model.codes * margins) * model.trust).sum(axis=1)
    p = np.exp(-model.sharp * (loss - loss.min()))
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return int(order[0]), float(p[order[0]]), float(p[order[0]] - p[order[1]]) if len(p) > 1 else 1.0


def learn(docs: DataFrame, may_learn, max_fit: int = MAX_FIT) -> Model | None:
    """A model from up to max_fit rows (about) with a lang, where the column may_learn holds; text and lang only."""
    prepare(docs.sparkSession)
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    scale = 1 << 30
    rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(scale)) < int(min(1.0, max_fit / max(n, 1)) * scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(t, v) for t, v in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True) if LETTER.search(t.decode())]
            yield pa.RecordBatch.from_arrays([pa.array([v for _, v in keep], pa.string()), pa.array([features(t).astype(np.float16).tobytes() for t, _ in keep], pa.binary())], ["lang", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((lang, x) for batch in batches for lang, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        order = np.random.default_rng(3).permutation(len(found))
        model = fit(np.array([np.frombuffer(found[i][1], np.float16) for i in order], np.float32), [found[i][0] for i in order]) if found else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(lean(run), "lang string, x binary").limit(int(1.2 * max_fit) + 200)  # 8 KiB a row
    fitted = sample.repartition(1).mapInArrow(lean(solve), "model binary").collect()  # one task of at most 40 MB of rows
    return pickle.loads(fitted[0].model) if fitted else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a struct column (lang_pred, score, ambiguous), named `_language` unless docs has such a column, whatever
    its case: then with as many further _ as make it new (`common.column_free_name` tells the name).

    `und` with score 0 where the text is null, empty or has no letters, or where nothing was learned. A very long text
    counts whole, in blocks. Of languages that are equally near the first by name wins, with ambiguous set. Rows that
    repeat get the same answer; other columns pass unchanged; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x bits

    @F.arrow_udf("struct<lang_pred string, score double, ambiguous boolean>")
    def predict(text: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for t in text.cast(pa.binary()).to_pylist():
            if m is None or not t or not LETTER.search(t.decode()):
                out.append((NONE, 0.0, True))
                continue
            best, p, lead = decode(features(t) @ m.weights[:-1] + m.weights[-1], m)
            out.append((m.languages[best], p, lead < 0.1))
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], ["lang_pred", "score", "ambiguous"])

    return docs.withColumn(column_free_name(docs, "_language"), predict(F.col("text").cast("string")))
