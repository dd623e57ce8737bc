"""BLAKE3 (the published specification, hash mode, 32 bytes), vectorised over all chunks of a batch of inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
_MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv (n, 8), words (n, 16) to the next chaining values (n, 8)."""
    low, high = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v = [*cv.T.copy(), *(np.full(len(cv), k, np.uint32) for k in IV[:4]), low, high, size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words.T.copy())
    for r in range(7):
        for i, (a, b, c, d) in enumerate(_MIXES):
            for x, s, t in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] = v[a] + v[b] + x
                v[d] = _turned(v[d] ^ v[a], s)
                v[c] = v[c] + v[d]
                v[b] = _turned(v[b] ^ v[c], t)
        m = [m[p] for p in PERMUTATION] if r < 6 else m
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def hashes(inputs: list[bytes]) -> list[str]:
    """The hexadecimal hash of each input."""
    if not inputs:
        return []
    sizes = np.array([len(x) for x in inputs], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    first = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(inputs)), chunks)
    place = np.arange(len(doc)) - first[doc]
    data = b"".join(x + b"\0" * (int(n) * CHUNK - len(x)) for x, n in zip(inputs, chunks, strict=True))
    words = np.frombuffer(data, "<u4").reshape(len(doc), CHUNK // BLOCK, 16)
    length = np.minimum(CHUNK, sizes[doc] - place * CHUNK)
    blocks = np.maximum(1, -(-length // BLOCK))
    cv = np.tile(IV, (len(doc), 1))
    for b in range(CHUNK // BLOCK):
        live = np.flatnonzero(blocks > b)
        if not len(live):
            break
        last = blocks[live] == b + 1
        flags = np.where(b == 0, CHUNK_START, 0) | np.where(last, CHUNK_END, 0) | np.where(last & (chunks[doc[live]] == 1), ROOT, 0)
        cv[live] = _compress(cv[live], words[live, b], place[live].astype(np.uint64), np.clip(length[live] - b * BLOCK, 0, BLOCK), flags)
    while len(cv) > len(inputs):  # neighbours are joined, the odd last one moves up
        count = np.bincount(doc, minlength=len(inputs))
        first = np.cumsum(count) - count
        place = np.arange(len(doc)) - first[doc]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[doc]))
        root = np.where(count[doc[left]] == 2, ROOT, 0)
        joined = _compress(np.tile(IV, (len(left), 1)), np.concatenate([cv[left], cv[left + 1]], axis=1), np.zeros(len(left), np.uint64), np.full(len(left), BLOCK), PARENT | root)
        cv[left] = joined
        keep = np.ones(len(cv), bool)
        keep[left + 1] = False
        cv, doc = cv[keep], doc[keep]
    return [x.astype("<u4").tobytes().hex() for x in cv]


def _hex(content: pd.Series) -> pd.Series:
    """Inputs are hashed in groups of about 4 MB."""
    out, held, at, size = [None] * len(content), [], [], 0
    for i, x in enumerate(content):
        if x is not None:
            held.append(bytes(x))
            at.append(i)
            size += len(x)
        if held and (size > 1 << 22 or i == len(content) - 1):
            for k, h in zip(at, hashes(held), strict=True):
                out[k] = h
            held, at, size = [], [], 0
    if held:
        for k, h in zip(at, hashes(held), strict=True):
            out[k] = h
    return pd.Series(out, dtype=object)


def blake3_hex(content: Column) -> Column:
    """The hash of a binary column, hexadecimal; null for null."""
    return F.pandas_udf(_hex, "string")(content)
