"""Vectorised text primitives on Arrow buffers: words, word hashes, shingle hashes.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Hashes are 64-bit and the same on every machine.
Work is done in slices of about ``SLICE`` bytes cut between documents, so memory follows the longest
document and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_C = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII punctuation and controls become spaces, for comparisons that ignore them.
_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32
_pow = np.ones(1, np.uint64)


def tidied(f: Callable) -> Callable:
    """f, a function of Arrow batches; at a partition's end the worker, which other tasks reuse, gives free memory back."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        _pow = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 256) * 2, _BASE, np.uint64)]), dtype=np.uint64)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(data: np.ndarray, off: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each document's range in them (n + 1 offsets).

    plain: ASCII punctuation counts as white space.
    """
    data = (_PLAIN if plain else _LOWER)[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = inside[begin]
    starts = np.flatnonzero(first)
    wo = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), wo
    kept = np.flatnonzero(inside)
    at = np.searchsorted(kept, starts)
    pos = np.arange(len(kept)) - np.repeat(at, np.diff(np.append(at, len(kept))))
    h = np.add.reduceat(_BYTE[data[kept]] * powers(int(pos.max()) + 1)[pos], at)
    return mix(h), wo


def shingle_hashes(words: np.ndarray, wo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words; a shorter document that has words counts as one run."""
    count = np.diff(wo)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    so = np.concatenate([[0], np.cumsum(per)])
    if not so[-1]:
        return np.zeros(0, np.uint64), so
    h = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        for i in range(n):
            h[:m] += words[i : i + m] * _C[i]
    doc = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(words)) - np.repeat(wo[:-1], count)
    out = np.zeros(so[-1], np.uint64)
    long = within <= (count[doc] - n)
    out[so[doc[long]] + within[long]] = mix(h[long])
    for d in np.flatnonzero((count > 0) & (count < n)):
        w = words[wo[d] : wo[d + 1]]
        out[so[d]] = mix((w * _C[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _C[40 + len(w)])[0]
    return out, so


def shingle_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    data, off = buffers(col)
    for a, b in slices(off):
        w, wo = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        s, so = shingle_hashes(w, wo, n)
        for i in range(b - a):
            x = s[so[i] : so[i + 1]]
            yield a + i, np.unique(x) if len(x) > 1 else x
