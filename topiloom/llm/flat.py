"""Texts of an Arrow batch as one flat byte array, and vectorised words and hashes over it.

Spark hands a task its rows in Arrow batches. The helpers here look at the bytes of a
string column in place, half a megabyte at a time, so a task needs memory for one slice
and its longest text, whatever the size of the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and the ASCII controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANK
#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CODES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the usual xor-shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _held or len(_held[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        _held.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _held.append(np.multiply.accumulate(p, out=p))
    return _held[0], _held[1]


class Slice:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each text begins and ends."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(array: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``size`` bytes; null is an empty text."""
    array = array.cast(pa.large_string())
    n = len(array)
    if not n:
        return
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of ``kind``; no run crosses rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[offsets < len(data)]
    first[edges] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


class Hasher:
    """64-bit hashes of any stretch of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(len(data) + 1)
        self._sums = np.empty(len(data) + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(_CODES[data] * up[:len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_one(text: str | bytes) -> int:
    """The hash that ``Hasher`` gives the same bytes."""
    raw = text.encode() if isinstance(text, str) else text
    data = np.frombuffer(raw, np.uint8)
    return int(Hasher(data)(np.array([0]), np.array([len(data)]))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_row(counts_at: np.ndarray, n: int) -> np.ndarray:
    """First index of each of ``n`` rows, and one past the last, in sorted row numbers."""
    return np.searchsorted(counts_at, np.arange(n + 1))


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end the worker gives freed memory back.

    Workers are reused by later stages, and what their allocators keep would add up.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
