"""Words of whole Arrow columns as byte ranges and hashes, without a Python object for each word.

A separator is an ASCII byte that a table names; letters A-Z are lower-cased, bytes of other scripts are always part of words. Work goes through
the column's own buffer, some hundred thousand bytes at a time, so memory doesn't grow with a batch or a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

STEP = 1 << 19  # bytes whose words are hashed at a time; a longer word is hashed whole
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xBF58476D1CE4E5B9)


def lowered(separators: list[tuple[int, int]]) -> np.ndarray:
    """For each byte what it counts as: 0 for those within the ranges (ends inclusive), lower case for A-Z, else itself."""
    out = np.arange(256, dtype=np.uint8)
    for a, b in separators:
        out[a : b + 1] = 0
    upper = out[65:91]
    upper[upper > 0] += 32
    return out


@dataclass
class Words:
    """low: the bytes, separators 0; begin, end: byte ranges of the words; row: the text of each; texts: their number; hash: of each word's bytes."""

    low: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    texts: int
    hash: np.ndarray

    def said(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by a space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.begin[a:b].tolist(), self.end[a:b].tolist(), strict=True))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


def _hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes modulo 2 to the 64, scrambled."""
    out, at = np.zeros(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + STEP, side="right")))
        s, e = int(begin[at]), int(end[to - 1])
        power, back = _powers(STEP) if e - s <= STEP else _powers.__wrapped__(e - s)
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(low[s:e] * power[: e - s], out=sums[1:])
        out[at:to] = (sums[end[at:to] - s] - sums[begin[at:to] - s]) * back[begin[at:to] - s]
        at = to
    return scrambled(out)


def words(column: pa.Array, lower: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, Words]]:
    """The words of a column of strings, about `most` bytes of whole texts at a time, with the place of the first text. A null counts as empty."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        low = lower[data[off[at] : off[to]]]
        word = low != 0
        edge = off[at : to + 1] - off[at]
        start, stop = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        inner = edge[1:-1]  # words don't reach from one text to the next
        inner = inner[(inner > 0) & (inner < len(low))]
        start[inner] |= word[inner]
        stop[inner - 1] |= word[inner - 1]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        row = np.searchsorted(edge[1:], begin, side="right")
        yield at, Words(low, begin, end, row, to - at, _hashes(low, begin, end))
        at = to


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words at which a shingle of `size` words of one text starts, and hashes of those shingles."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    total = np.full(len(whole), np.uint64(size))
    for j in range(size):
        total = total * np.uint64(BASE) + w.hash[whole + j]
    return whole, scrambled(total)
