"""Vectorised text helpers on Arrow buffers: words, hashes and shingles without a Python object per word."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def _trim() -> None:
    """Hand freed memory back to the system: workers live on between tasks, two to an executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over Arrow batches that leaves its worker small when it ends."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
SLICE = 1 << 18

_bytes = np.arange(256)
#: Word bytes: digits, ASCII letters and all bytes of non-ASCII characters.
WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: Lower-cases A-Z alone.
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    parts = column.buffers()
    if len(column) == 0 or parts[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(parts[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if parts[2] is None else np.frombuffer(parts[2], np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def spans(inside: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inside holds, cut at row starts; and where each row's runs begin in them."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        at = rows[(rows > 0) & (rows < n)]
        before[at], after[at - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, rows)


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of low[start:end] for sorted, disjoint, non-empty spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = place + np.repeat(start, size)
    return mix(np.add.reduceat(_VALUE[low[at]] * _POWER[place & 1023], first) + size.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, and where each row's words begin in them."""
    low = LOWER[data[offsets[0] : offsets[-1]]]
    start, end, ptr = spans(WORD[low], offsets - offsets[0])
    return hash_spans(low, start, end), ptr


def shingle_hashes(words: np.ndarray, ptr: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words by row; a row of fewer words, but some, is one shingle."""
    count = np.diff(ptr)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_ptr = np.concatenate([[0], np.cumsum(n)])
    if not out_ptr[-1]:
        return np.zeros(0, np.uint64), out_ptr
    at = np.repeat(ptr[:-1] - out_ptr[:-1], n) + np.arange(out_ptr[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    left = np.repeat(ptr[1:], n) - at
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += np.where(left > j, padded[at + j] * _PLACE[j], np.uint64(0))
    return mix(total), out_ptr
