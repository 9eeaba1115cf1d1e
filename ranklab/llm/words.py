"""Vectorised words of text columns, used inside Arrow tasks.

A string column is cut into slices of about ``SLICE_BYTES`` (one longer text
is a slice of its own); each slice is one byte array, and word bounds and
word codes come from array operations over it. Memory per task is therefore a
small multiple of the slice, whatever the batch or partition size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the entropy of ``x`` over all 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of runs of consecutive values: ``sum(v[i + j] * base**j)`` modulo 2**64, finalised."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def __reduce__(self):
        return Rolling, (self.base,)

    @staticmethod
    def _powers(x: int, size: int) -> np.ndarray:
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.pow) < n:
            size = max(n, 2 * SLICE_BYTES + 2)
            self.pow, self.inv = (self._powers(x, size) for x in (self.base, self.inverse))
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.pow[:n - 1], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((prefix[hi] - prefix[lo]) * self.inv[lo])

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``values[i:i + width]`` for every i; empty if there are fewer values."""
        n = len(values) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        p = self.prefix(values)
        return mix64((p[width:] - p[:n]) * self.inv[:n])


_BYTES = Rolling(0x2545F4914F6CDD1D)


class Slice:
    """Rows ``lo .. hi`` of a string column as one byte array with its words.

    ``starts`` / ``ends``: byte bounds of the words; ``first``: for each row
    the index of its first word, with the total at the end. A null text has
    no bytes. No word reaches over the end of its row.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lo: int, lower: bool = False, space: np.ndarray = _SPACE):
        self.lo, self.hi = lo, lo + len(offsets) - 1
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets
        solid = ~space[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        finish = solid.copy()
        finish[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._prefix = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.n_words)

    def byte_prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = _BYTES.prefix(_BYTE_CODE[self.buf])
        return self._prefix

    def codes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit codes of the words, or of the given byte spans."""
        if starts is None:
            starts, ends = self.starts, self.ends
        return _BYTES.spans(self.byte_prefix(), starts, ends)

    def text(self, row: int) -> bytes:
        return self.buf[self.offsets[row]:self.offsets[row + 1]].tobytes()

    def windows(self, width: int) -> np.ndarray:
        """For each word position: True where ``width`` words of the same row begin."""
        n = len(self.starts)
        left = np.repeat(self.first[1:], self.n_words) - np.arange(n)
        return left >= width


def code_of(word: bytes) -> int:
    """The code that ``Slice.codes`` gives to this word."""
    b = np.frombuffer(word, np.uint8)
    p = _BYTES.prefix(_BYTE_CODE[b])
    return int(_BYTES.spans(p, np.array([0]), np.array([len(b)]))[0])


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, space: np.ndarray = _SPACE) -> Iterator[Slice]:
    """The column's rows in order, in slices of whole rows; ``space`` tells for each byte, lower-cased if so wished, whether it separates words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if big else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Slice(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lo, lower, space)
        lo = hi


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x
