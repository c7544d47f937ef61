"""Columnar text kernels shared by the operators of this package.

A partition's Arrow batches are cut into blocks of bounded size; every kernel then works on one flat array of code
points with offsets, so the cost per character is a few vectorised passes and no Python call per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 1 << 19

OTHER, SPACE, NEWLINE, DIGIT, LETTER, MARK, CAP = range(7)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point of the basic plane; the rest counts as OTHER, unchanged."""
    kind, lower = np.zeros(0x10001, np.uint8), np.arange(0x10001, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        g = unicodedata.category(c)
        if c in "\n\u2028\u2029":
            kind[i] = NEWLINE
        elif c.isspace():
            kind[i] = SPACE
        elif g[0] == "N":
            kind[i] = DIGIT
        elif g == "Lu":
            kind[i] = CAP
        elif g[0] == "L":
            kind[i] = LETTER
        elif g[0] == "M":
            kind[i] = MARK
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return kind, lower


class Block:
    """Code points of a run of rows. ``start`` has one entry more than there are rows."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.start[1:])
        kind, lower = tables()
        low = np.minimum(self.cp, 0x10000)
        self.kind = kind[low]
        self.kind[low == 0x10000] = LETTER
        self.low = np.where(low < 0x10000, lower[low], self.cp)

    def rows_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, "right") - 1


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``chars`` characters, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + chars, "right")))
            yield batch.slice(at, end - at)
            at = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a row beyond the block size gets its own, which are not kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (_P, _PINV):
        power = np.full(max(n, BLOCK_CHARS), base, np.uint64)
        power[0] = 1
        both.append(np.cumprod(power))
    if n <= BLOCK_CHARS:
        _POWERS[:] = both
    return both[0][:n], both[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of ``values``, independent of where the span lies."""
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * power, out=total[1:])
        h = (total[ends] - total[starts]) * inverse[np.minimum(starts, n - 1)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def word_hash(word: str) -> int:
    a = np.array([ord(c) for c in word], np.uint32)
    return int(span_hashes(a, np.array([0]), np.array([len(a)]))[0])


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))
