"""Hashes of word shingles, for all texts of an Arrow batch at once.

Words are found and hashed as bytes of the batch's buffer, eight at a time; nothing is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

FOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SALT = np.uint64(0xA0761D6478BD642F)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of texts that are looked at together; a longer text is looked at alone.
BLOCK = 512 << 10
#: Words of more bytes are hashed on their own.
LONG_WORD = 512


def mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data has eight spare bytes at its end."""
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mixed(size.astype(np.uint64) * FOLD ^ (eight[starts] & FIRST[np.minimum(size, 8)]), SALT)
    done, more = 8, np.flatnonzero(size > 8)
    while len(more) and done < LONG_WORD:
        x = eight[starts[more] + done] & FIRST[np.minimum(size[more] - done, 8)]
        h[more] = mixed(h[more] * FOLD + x, SALT)
        done += 8
        more = more[size[more] > done]
    for i in more:
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes()))
    return h


def _shingles(data: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """data: lower-cased bytes and eight spare ones; rows: where each text begins, and where the last one ends."""
    n = len(data) - 8
    word = ~BLANK[data[:n]]
    edge = np.ones(n + 1, bool)  # whether no word goes on from the byte before to this one
    edge[1:n] = ~(word[1:] & word[:-1])
    edge[rows] = True
    starts, ends = np.flatnonzero(word & edge[:n]), np.flatnonzero(word & edge[1:]) + 1
    h = _word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, rows)
    first, words = cuts[:-1], np.diff(cuts)
    places = np.where(words >= size, words - size + 1, np.minimum(words, 1))

    def joined(at: np.ndarray | slice, width: int) -> np.ndarray:
        """Of windows of that width which begin at words `at`."""
        acc = np.full(at.stop - at.start if isinstance(at, slice) else len(at), width, np.uint64)
        for j in range(width):
            acc = mixed(acc * FOLD + (h[at.start + j : at.stop + j] if isinstance(at, slice) else h[at + j]), SALT)
        return acc

    every = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        every[: len(h) - size + 1] = joined(slice(0, len(h) - size + 1), size)
    for width in range(1, size):
        short = first[words == width]
        if len(short):
            every[short] = joined(short, width)
    keep = np.arange(len(h)) - np.repeat(first, words) < np.repeat(places, words)
    return every[keep], np.r_[0, np.cumsum(places)]


def of_text(text: bytes, size: int) -> np.ndarray:
    """The hash of each place's shingle; fewer words than size give one shingle, none give none."""
    data = np.empty(len(text) + 8, np.uint8)
    data[:-8] = LOWER[np.frombuffer(text, np.uint8)]
    data[-8:] = 0
    return _shingles(data, np.array([0, len(text)]), size)[0]


def of_batch(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For consecutive rows of a text column: the first row, and the sorted distinct hashes of each row's shingles,
    joined, with their offsets. Null counts as empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
        data = np.empty(at[last] - at[row] + 8, np.uint8)
        data[:-8] = LOWER[bytes_[at[row] : at[last]]]
        data[-8:] = 0
        hashes, offsets = _shingles(data, at[row : last + 1] - at[row], size)
        yield row, *distinct(hashes, offsets)
        row = last


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's part sorted and without repeats."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        hashes[a:b].sort()
    first = np.ones(len(hashes) + 1, bool)
    first[1:-1] = hashes[1:] != hashes[:-1]
    first[offsets] = True
    return hashes[first[:-1]], np.r_[0, np.cumsum(first[:-1])][offsets]
