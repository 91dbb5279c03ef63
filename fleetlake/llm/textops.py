"""Vectorised helpers over Arrow text columns, shared by the operators that run in Python tasks.

A column of texts is seen as one byte array plus offsets, so hashing words, shingles or windows
costs a few numpy passes instead of a Python loop over characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is still taken whole.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


#: Drop what a worker keeps for later tasks of its operator.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """Give back what this worker still holds from other tasks: tables kept for later ones, and freed memory that was not returned.

    Spark hands a worker from one stage to the next, so what one leaves adds to what the next takes.
    """
    for drop in KEPT:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


BYTE_CODES = _byte_codes(11)

#: ASCII white space: space and \t..\r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of at most ``limit`` bytes, one row at least; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Wrapping powers 0..n-1 of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, m in enumerate((_MULT, _INV)):
            x = np.full(size, U64(m))
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


KEPT.append(lambda: _powers.__setitem__(slice(None), [np.ones(1, U64), np.ones(1, U64)]))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans hash equally wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-gap bytes, none across texts, and each text's first word number."""
    inside = ~is_gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text, and each text's first shingle.

    A text of fewer words, but not none, has one shingle: its whole sequence.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(made)))
    at = np.repeat(first[:-1], made) + np.arange(start[-1]) - np.repeat(start[:-1], made)
    length = np.minimum(np.repeat(count, made), n)
    padded = np.concatenate((words, np.zeros(n, U64)))
    out = length.astype(U64)
    for i in range(n):
        out = mix(out * U64(_MULT) + np.where(i < length, padded[at + i], U64(0)))
    return out, start
