"""Arrow string columns as numpy byte arrays, for the operators that work on bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_C = ctypes.CDLL(None)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)


def tidy() -> None:
    """Give back what earlier tasks of this Python worker left on the heap and in Arrow's pool: workers are reused by stage after stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `most` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        root = _ROOT if kind == "up" else np.uint64(pow(int(_ROOT), -1, 2**64))
        have = np.full(max(n, 2 * len(have)), root, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


class Spans:
    """64-bit hashes of any spans of a byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power("up", len(data)), out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that aren't ASCII white space."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    full = offsets[1:] > offsets[:-1]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = solid[first], solid[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def total(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask holds."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def space_mask(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lead_mask(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a UTF-8 column, and each row's number of them. What is no character counts as U+FFFD."""
    lead = np.flatnonzero(lead_mask(data))
    out = data[lead].astype(np.uint32)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        first = out[wide]
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        value = first & (0x3F >> more).astype(np.uint32)
        for k in (1, 2, 3):
            follows = data[np.minimum(lead[wide] + k, len(data) - 1)].astype(np.uint32) & 0x3F
            value = np.where(more >= k, value << 6 | follows, value)
        value[(value > 0x10FFFF) | (value >= 0xD800) & (value <= 0xDFFF)] = 0xFFFD
        out[wide] = value
    return out, np.diff(np.searchsorted(lead, offsets))


def strings(points: np.ndarray) -> pa.Array:
    """The rows of a matrix of code points as a column of strings."""
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(1)
    data = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(data))
