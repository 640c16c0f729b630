"""Whole-batch text arithmetic on the UTF-8 bytes of Arrow columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. All separators are single
ASCII bytes, so words, lines and their hashes come from a few numpy passes over
the batch's buffer, with no Python object for a word. Hashes are polynomials
modulo 2**64 over random byte values, read off prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once; a longer document is handled alone.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(28))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def salt(n: int) -> np.uint64:
    """The n-th fixed random constant."""
    with np.errstate(over="ignore"):
        return mix(np.array([n + 1], U) * U(0x9E3779B97F4A7C15))[0]


_BYTE = np.array([salt(1000 + i) for i in range(256)], U)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            if size > 1 << 23:  # don't keep what a single huge text needs
                return _powers(self.base, n), _powers(self.inverse, n)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES, _RUNS, _RUNS2 = _Powers(0xF1357AEA2E62A9C5), _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)


class Runs:
    """Hashes of any run [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, second: bool = False):
        n = len(values)
        up, self.down = (_RUNS2 if second else _RUNS).to(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U) * salt(7))

    def windows(self, k: int) -> np.ndarray:
        """Of all windows of k values, in order."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + U(k) * salt(7))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into row ranges of about STEP_BYTES of text."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        row, rows = 0, batch.num_rows
        while row < rows:
            end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1
            end = min(max(end, row + 1), rows)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


@dataclass
class Words:
    """Words of a piece: byte ranges, first word of each row, and hashes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1
    row: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find the words of each row."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(rows + 1, np.int64), none)
    solid = ~_SPACE[data]
    full = offsets[:-1] < offsets[1:]
    before = np.empty(n, bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][full]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[:-1] = solid[1:]
    after[offsets[1:][full] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(data, offsets, start, end, first, np.repeat(np.arange(rows), np.diff(first)))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, U)
    up, down = _BYTES.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * salt(3))


def same_row(w: Words, k: int) -> np.ndarray:
    """For each window of k words, whether it lies in one row."""
    if len(w.row) < k:
        return np.zeros(0, bool)
    return w.row[: len(w.row) - k + 1] == w.row[k - 1 :]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
