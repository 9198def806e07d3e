"""Words and word windows of many texts at once, as 64-bit numbers, in numpy.

Words are runs of bytes other than ASCII white space. A word's number is a polynomial over its bytes, a window's number one over its
words, both modulo 2^64 and mixed at the end. Prefix sums give all windows of a text in a few array steps. Two lanes with
different tables make 128 bits, where equal numbers must mean equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE) + np.uint64(lane * 0x632BE59BD9B4E019 & (2**64 - 1)))


TABLES = [_table(0), _table(1)]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^(n-1) modulo 2^64, and their inverses."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, SEGMENT)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        found = np.cumprod(up), np.cumprod(down)
        if size > 4 * SEGMENT:
            return found
        _POWERS[base] = found
    return _POWERS[base]


class Words:
    """The words of a run of texts: ``start`` and ``end`` in ``data``, and ``first``: the number of words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        word = ~SPACE[self.data]
        joins = np.empty(len(word), bool)
        joins[:1] = False
        joins[1:] = word[:-1]
        joins[offsets[:-1][offsets[:-1] < len(word)]] = False
        self.start = np.flatnonzero(word & ~joins)
        joins[:-1] = word[1:]
        joins[-1:] = False
        joins[offsets[1:][offsets[1:] > 0] - 1] = False
        self.end = np.flatnonzero(word & ~joins) + 1
        self.first = np.searchsorted(self.start, offsets)

    def numbers(self, lane: int = 0) -> np.ndarray:
        """One 64-bit number for each word."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SEGMENT, side="right")))
            high = self.end[to - 1]
            up, down = powers(BYTE_BASE, int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(TABLES[lane][self.data[low:high]] * up[: high - low], out=sums[1:])
            s, e = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out


def windows(numbers: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (index of the word) and number of every window of ``length`` words that lies inside one text."""
    n = len(numbers)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left >= length)
    up, down = powers(WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers * up[:n], out=sums[1:])
    return at, mix((sums[at + length] - sums[at]) * down[at])


def text_runs(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of a binary or string column in runs of about ``limit`` bytes: from, to, their bytes and offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    big = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if big else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
