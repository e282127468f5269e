"""Word kernels over whole Arrow batches of text: offsets and 64-bit hashes, no per-word Python.

A batch is cut into runs of documents of about ``CHUNK`` bytes, so that memory is bounded by
that and the longest single document.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _odd_inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of mixed values behave as random."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Give free memory back: a worker waits for its next task beside others that need it."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(rows: Callable) -> Callable:
    """A function over batches that releases memory at its end."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def _table(excluded: bytes) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(excluded)] = False
    return t


#: Bytes that are part of a word: everything but ASCII white space.
NON_SPACE = _table(b" \t\n\x0b\f\r")
#: Bytes that are part of a word: digits, small letters and everything beyond ASCII (after folding).
ALNUM = np.array([chr(b).isdigit() or "a" <= chr(b) <= "z" or b >= 0x80 if b < 0x80 else True for b in range(256)])
IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = IDENTITY.copy()
FOLD[65:91] += 32


class Words(NamedTuple):
    """Words of a run of documents: byte ranges, document index in the run, and where each document's words begin."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(documents) + 1


class Run(NamedTuple):
    """Documents low..high of a batch; offsets are into data."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[Run]:
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + chunk, side="right")) - 1)
        high = min(high, n)
        yield Run(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NON_SPACE) -> Words:
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[n - 1 :] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(begin, offsets)
    return Words(begin, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def word_hashes(data: np.ndarray, w: Words, fold: np.ndarray = IDENTITY, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each word's bytes, the same wherever the word stands."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * powers(base, n), out=sums[1:])
    h = (sums[w.end] - sums[w.begin]) * powers(_odd_inverse(base), n + 1)[w.begin]
    return mix(h + (w.end - w.begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(h: np.ndarray, length: int, base: np.uint64 = WINDOW_BASE) -> np.ndarray:
    """Rolling polynomial hashes of every ``length`` consecutive entries (also over document edges; mask those)."""
    n = len(h)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(_odd_inverse(base), n)[: n - length + 1])


def sliding_argmin(v: np.ndarray, span: int) -> np.ndarray:
    """For each i, the leftmost position of the least of v[i : i + span]; by doubling."""
    if len(v) < span:
        return np.zeros(0, dtype=np.int64)
    best, covered = np.arange(len(v)), 1
    while covered < span:
        step = min(covered, span - covered)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(v[b] < v[a], b, a)
        covered += step
    return best
