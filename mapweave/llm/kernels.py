"""Vectorised text kernels for Arrow batches.

They work on the UTF-8 bytes of a whole chunk of rows at once, so that the cost of a word is that of a few
NumPy operations. A word is a run of bytes other than space and 0x09-0x0D; those bytes never occur inside
the UTF-8 form of another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are handled at once; a longer row is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U64(1), np.full(size - 1, _MULTIPLIER, U64)], dtype=U64)
                self.down = np.cumprod(np.r_[U64(1), np.full(size - 1, _INVERSE, U64)], dtype=U64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, whatever the place of the range."""
    up, down = _POWERS.upto(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(values) + 1, U64)
        sums[0] = 0
        np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], dtype=U64, out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
        return mix(found + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of a chunk of rows: byte places, hashes, and for each row its range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        self.data = _LOWER[data] if lower else data
        gap = _SPACE[data]
        inside = ~gap
        n = len(data)
        before = np.ones(n + 1, bool)
        before[1:] = gap
        before[offsets[:-1]] = True
        after = np.ones(n + 1, bool)
        after[:n] = gap
        after[offsets[1:]] = True
        self.starts = np.flatnonzero(inside & before[:n])
        self.ends = np.flatnonzero(inside & after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def grams(self, n: int, words: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each word on; only meaningful where n words of the row are left."""
        words = self.hashes() if words is None else words
        last = np.minimum(np.arange(len(words)) + n, len(words))
        return range_hashes(words, np.arange(len(words)), last)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) over a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
