"""SentencePiece segmentations drawn without replacement, by Gumbel top-k.

A text's lattice has an edge for every vocabulary piece (characters outside the vocabulary go through byte pieces).
Pieces never cross into the next word, nor touch a character that only stands alone, so a text's lattice is its units'
lattices in a row and units are prepared once for each worker. Log sums of all ways to go on from a place turn edge
weights into conditional probabilities, and make an exact bound: a partial segmentation's perturbed value is the
maximum over all its completions. A* goes on with the partial segmentation of the greatest value first and, given that
maximum, draws the value of all its other ways to go on together, so complete ones come out in order, distinct. The
(k+1)-th value is the threshold of the inclusion scores.

Values are held as logs of arrival times (minus the Gumbel value). Complete segmentations arrive like a Poisson process
of their probabilities, which has no memory: when one has come at time t, those that part from it at some place come
first at t plus an exponential draw over their joint probability, and which of them it is need not be drawn before it
is looked at. Each partial segmentation waiting stands for one complete one with its very value, so only the k+1 best
need to wait. A unit with few segmentations is one choice between whole ones instead of a walk from place to place.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from bisect import bisect, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare

#: SentencePiece's mark of a blank.
SPACE = "▁"
#: Flattens (under 1) or sharpens the pieces' distribution.
POWER = 0.8
#: Ways whose chance to come among the best is under exp of this are not drawn.
HOPELESS = -46.0
#: Edges that a worker holds, of units up to so many characters; whole segmentations of a unit that is one choice.
HELD_EDGES, HELD_UNIT, WHOLE = 200_000, 64, 32


class Lattices(dict):
    """Unit (a word with its leading blanks, or a character) to its choices, place by place: running sums of the
    shares, shares, and for each way (next place, ids as little-endian bytes, log share). Holds HELD_EDGES ways."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.spelled, self.held = {}, {}, [], 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.spelled.append(piece.replace(SPACE, " ").encode())
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and SPACE not in piece.lstrip(SPACE):
                self.pieces[piece.replace(SPACE, " ")] = (array("i", [i]).tobytes(), -POWER * math.log(i + 10))
        self.longest = max(map(len, self.pieces))
        joint = re.escape("".join(sorted({c for piece in self.pieces if len(piece) > 1 for c in piece} - {" "})))
        self.split = re.compile(f" *[{joint}]+| +|[^ {joint}]" if joint else "(?s:.)").findall

    def ways(self, unit: str, i: int, after) -> list[tuple[int, bytes, float]]:
        """(next place, ids, log weight of all that goes on so) from place i, given those of later places."""
        out, pieces = [], self.pieces
        for j in range(i + 1, min(len(unit), i + self.longest) + 1):
            if (part := unit[i:j]) in pieces:
                ids, w = pieces[part]
                out.append((j, ids, w + after[j]))
        if unit[i] not in pieces:
            spelled = array("i", [self.bytes[b] for b in unit[i].encode()])
            out.append((i + 1, spelled.tobytes(), -POWER * 12 * len(spelled) + after[i + 1]))
        return out

    def choice(self, unit: str, i: int, after) -> tuple:
        """The ways from place i, for which after[i] is set."""
        own = self.ways(unit, i, after)
        top = max([w for _, _, w in own])
        parts = [math.exp(w - top) for _, _, w in own]
        total = sum(parts)
        rest = after[i] = top + math.log(total)
        shares = [p / total for p in parts]
        return list(accumulate(shares)), shares, [(j, ids, w - rest) for j, ids, w in own]

    def __missing__(self, unit: str):
        n = len(unit)
        after = array("d", bytes(8 * (n + 1)))  # the log weight of all segmentations of the rest from each place
        if n > HELD_UNIT:
            for i in range(n - 1, -1, -1):
                self.choice(unit, i, after)
            return Long(self, unit, after)
        got = [self.choice(unit, i, after) for i in range(n - 1, -1, -1)][::-1]
        count = [0] * n + [1]
        for i in range(n - 1, -1, -1):
            count[i] = sum(count[j] for j, _, _ in got[i][2])
        if count[0] <= WHOLE:
            every = [(0, b"", 0.0)]
            while any(j < n for j, _, _ in every):
                every = [(k, ids + more, w + v) for j, ids, w in every for k, more, v in (got[j][2] if j < n else ((n, b"", 0.0),))]
            shares = [math.exp(w) for _, _, w in every]
            got = [(list(accumulate(shares)), shares, every)]
        self.held += sum(len(x[1]) for x in got)
        if self.held > HELD_EDGES:
            self.clear()
            self.held = sum(len(x[1]) for x in got)
        self[unit] = got
        return got

    def units(self, text: str) -> list[str]:
        return self.split(" " + text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))[1:]


class Long:
    """Choices of a long unit, made when asked for: a number is held for each place, not its ways."""

    def __init__(self, lattices: Lattices, unit: str, after):
        self.lattices, self.unit, self.after = lattices, unit, after

    def __getitem__(self, i: int) -> tuple:
        return self.lattices.choice(self.unit, i, self.after)


def sample(text: str, k: int, seed: int, lattices: Lattices) -> list[tuple[bytes, float, float]]:
    """Up to k distinct segmentations (ids as little-endian bytes, log probability, inclusion score), by falling
    perturbed value."""
    names = lattices.units(text)
    units, ends = [lattices[u] for u in names], [len(u) for u in names]
    rng, log, log1p, exp, expm1 = random.Random(seed).random, math.log, math.log1p, math.exp, math.expm1
    last, found, serial, late = len(units), [], 0, math.inf
    # log arrival time, serial, log probability, unit, place, ways of this choice that are gone, parts; sorted
    waiting: list[tuple] = [(log(-log(rng() or 1e-300)), 0, 0.0, 0, 0, (), [])]
    while waiting:
        time, _, phi, u, i, gone, before = waiting.pop(0)
        if len(found) == k:
            late = time
            break
        places, drawing, parts = k - len(found), True, before.copy()
        while u < last:
            sums, shares, ways = units[u][i]
            if len(ways) == 1:
                i, ids, _ = ways[0]
                parts.append(ids)
            else:
                if gone:
                    left = [0.0 if a in gone else s for a, s in enumerate(shares)]
                    sums = list(accumulate(left))
                at = min(bisect(sums, rng() * sums[-1]), len(ways) - 1)
                while at in gone:  # rounding at the upper end
                    at -= 1
                if drawing or gone:
                    if len(waiting) >= places:
                        ahead = waiting[places - 1][0]
                        drawing = ahead > time and phi + ahead + log1p(-exp(time - ahead)) > HOPELESS
                    others = sum(s for a, s in enumerate(shares) if a != at and a not in gone)
                    if drawing and others > 0:
                        more = log(-log(rng() or 1e-300) or 1e-300) - phi - log(others)
                        value = max(time, more) + log1p(exp(-abs(time - more)))
                        if len(waiting) < places or value < waiting[places - 1][0]:
                            serial += 1
                            insort(waiting, (value, serial, phi, u, i, (*gone, at), parts.copy()))
                            del waiting[places:]
                    gone = ()
                i, ids, w = ways[at]
                phi += w
                parts.append(ids)
            if i == ends[u]:
                u, i = u + 1, 0
        found.append((phi, b"".join(parts)))
    return [(ids, phi, 1.0 if late == math.inf else -expm1(-exp(min(50.0, phi + late)))) for phi, ids in found]


_LATTICES: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(path)
    return _LATTICES[path]


def sample_segmentations(rows: DataFrame, keys: list[str], model: str, k: int = 3) -> DataFrame:
    """The key columns, rank (from 0), ids (binary, little-endian 32 bits), log_prob, inclusion and exact (whether the
    ids decode to the very text) of up to k segmentations of `text` for each row.

    The draws are seeded by the row's key, so a task that is run again draws the same; rows that repeat a key and text
    give the same rows, and equal texts of other keys draw on their own. Null text counts as empty, which has one
    segmentation: the leading space piece. A text's own U+2581 characters are spelled in bytes, so every text decodes
    to itself. A very long text is sampled whole; memory grows with its length, not with its lattice. Segmentations
    that are equally likely come in the order of their draws. Columns other than keys and text are ignored; a key may
    not bear the name of a result column. An empty table gives none.
    """
    prepare(rows.sparkSession)
    result = ["rank", "ids", "log_prob", "inclusion", "exact"]
    if clash := {c.lower() for c in keys} & set(result):
        raise ValueError(f"keys named like results: {sorted(clash)}")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model)
        for batch in batches:
            at, out, size = [], [], 0
            own = [batch.column(i).to_pylist() for i in range(len(keys))]
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                text = text or ""
                seed, plain = xxhash.xxh3_64_intdigest("\0".join(str(c[i]) for c in own)), text.encode()
                for r, (ids, p, s) in enumerate(sample(text, k, seed, lattices)):
                    at.append(i)
                    out.append((r, ids, p, s, lattices.decode(np.frombuffer(ids, "<i4").tolist()) == plain))
                    size += len(ids)
                if size >= 4 << 20 or i == batch.num_rows - 1:
                    take, cols = pa.array(at, pa.int64()), zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(take) for j in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], [*keys, *result])
                    at, out, size = [], [], 0

    return rows.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"{schema}, rank int, ids binary, log_prob double, inclusion double, exact boolean")


def decode_ids(ids, model: str):
    """A column of the texts of a binary column of ids (little-endian 32 bits); null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        lattices = lattices_of(model)
        return pa.array([None if v is None else lattices.decode(np.frombuffer(v, "<i4").tolist()).decode(errors="replace") for v in values.to_pylist()], pa.string())

    return run(ids)
