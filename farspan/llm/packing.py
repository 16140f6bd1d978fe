"""Packing by Karmarkar-Karp multiway differencing.

Every task streams its documents into groups of about GROUP_TOKENS tokens. Whole windows' worth of a long document
are cut off as windows of their own; what remains of it is cut into pieces of a quarter window at most. A group's pieces become partial partitions
(one piece and m-1 empty windows each). The two with the greatest spread are merged again and again, the fullest
windows of one onto the emptiest of the other, until one partition is left: m near-equal windows. If the fullest
exceeds the capacity, m rises and the group is dealt again. Nothing is shuffled, and a task holds one group.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, texts_of

CAPACITY = 2048
GROUP_TOKENS = 300 * CAPACITY
#: What remains of a document is cut into pieces of this share of the capacity at most: finer pieces even out better.
SHARE = 4
END = array("I", [1]).tobytes()  # unsigned 32 bits; little-endian on all machines Spark runs on
#: Marks that part from the letters before them as one token, whatever their number.
MARKS = ".,;:!?%$#&*|"


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window 0 .. m-1 of each piece."""
    n = len(sizes)
    left, right = np.full(n, -1), np.full(n, -1)
    heap = [(-int(s), i, (np.array([s]), np.array([i]))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts, serial = [(left, right)], n
    next_node = n
    while len(heap) > 1:
        (_, _, (a, x)), (_, _, (b, y)) = heapq.heappop(heap), heapq.heappop(heap)
        both = len(a) + len(b) - m
        if both > 0:  # windows in which both have pieces: a's least with b's greatest of the tail, in opposite order
            sums = a[len(a) - both :] + b[len(b) - both :][::-1]
            parts.append((x[len(a) - both :], y[len(b) - both :][::-1]))
            new = np.arange(next_node, next_node + both)
            next_node += both
            c = np.concatenate([a[: len(a) - both], b[: len(b) - both], sums])
            z = np.concatenate([x[: len(a) - both], y[: len(b) - both], new])
        else:
            c, z = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-c, kind="stable")
        c, z = c[order], z[order]
        if len(c) == m:
            c = c - c[-1]
        spread = int(c[0]) if len(c) < m else int(c[0] - c[-1])
        heapq.heappush(heap, (-spread, serial, (c, z)))
        serial += 1
    left, right = (np.concatenate(p) for p in zip(*parts, strict=True))
    window = np.full(next_node, -1)
    window[heap[0][2][1]] = np.arange(len(heap[0][2][1]))
    for node in range(next_node - 1, n - 1, -1):  # a merged node comes after what it is made of
        window[left[node]] = window[right[node]] = window[node]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; as few windows as differencing fits within the capacity."""
    total = int(sizes.sum())
    m = max(1, -(-total // capacity))
    while True:
        window = difference(sizes, m) if m > 1 else np.zeros(len(sizes), int)
        most = int(np.bincount(window, weights=sizes, minlength=m).max())
        if most <= capacity:
            return window
        m += 1


class Ids(dict):
    """Token ids (little-endian unsigned 32 bits) of each run of non-blank bytes, by the tokenizers library.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are its words' ids in a row.
    A word of Latin-1 characters is lower-cased and parted by the tokenizer's own pattern here, and its parts go to
    the BPE model; any other word goes to the tokenizer as a whole.
    """

    WORDS, PARTS = 150_000, 300_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        spec["normalizer"] = spec["pre_tokenizer"] = None
        self.bpe = Tokenizer.from_str(json.dumps(spec)).model
        steps = self.whole.to_str()
        split = next(p for p in json.loads(steps)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        from tokenizers.pre_tokenizers import ByteLevel

        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256)) if not c.isspace()}
        self.parts: dict[str, bytes] = {}
        self.special = any(t["special"] for t in json.loads(steps)["added_tokens"])

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= self.PARTS:
                self.parts.clear()
            shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part))
            ids = self.parts[part] = array("I", [t.id for t in self.bpe.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.WORDS:
            self.clear()
        text = word.decode()
        low = text.lower()
        core = low.rstrip(MARKS)
        if (core.isascii() or len(low) == len(text) and max(low) <= "\xff") and core.isalpha():
            ids = self._part(core) + (self._part(low[len(core) :]) if len(core) < len(low) else b"")
        elif max(text) <= "\xff" and text.isprintable() and not (self.special and "<|" in text):
            ids = b"".join(map(self._part, self.split(low)))
        else:
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens (with
    the end id 1), sequence_id, offset.

    Null or empty text is the end id alone. Each id of a document is in exactly one piece; rows that repeat, or have
    no doc_id, are packed as rows of their own. Sequence ids are the partition's number times 2^33 and a count, so a
    task that is run again over the same rows gives the same rows. Other columns are ignored. An empty table gives none.
    """
    prepare(docs.sparkSession)
    most = max(1, capacity // SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        serial = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []  # doc_id, start, ids, doc_tokens
        full: list[tuple] = []
        held = 0

        def rows(pieces: list[tuple], sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            doc, start, own, total = zip(*pieces, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in own], pa.int64()), pa.array(own, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            if full:
                yield rows(full, np.arange(serial, serial + len(full)), np.zeros(len(full), int))
                serial += len(full)
                full.clear()
            if pieces:
                own = list(pieces)
                sizes = np.array([len(p[2]) // 4 for p in own])
                window = pack(sizes, capacity)
                order = np.argsort(window, kind="stable")
                window, sizes = window[order], sizes[order]
                before = np.cumsum(sizes) - sizes
                first = np.r_[True, window[1:] != window[:-1]]
                offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(window)]))
                at = np.cumsum(first) - 1
                yield rows([own[i] for i in order], serial + at, offset)
                serial += int(at[-1]) + 1
                pieces.clear()
            held = 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                own = ids.of(text) + END
                n = len(own) // 4
                cut = n - n % capacity
                full += [(doc, at, own[4 * at : 4 * (at + capacity)], n) for at in range(0, cut, capacity)]
                pieces += [(doc, at, own[4 * at : 4 * min(at + most, n)], n) for at in range(cut, n, most)]
                held += n
                if held >= group_tokens:
                    yield from flush()
        yield from flush()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_crc(packed: DataFrame) -> DataFrame:
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
