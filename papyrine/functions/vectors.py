"""Vector expressions on arrays; sums are left folds in double precision, results single precision."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def l2_normalised(v: Column, least: float = 1e-12) -> Column:
    """v by its length, which counts as ``least`` at least."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(_double(v), lambda x: x / n).cast("array<float>")


def mean_pooled(tokens: Column, mask: Column, least: float = 1e-9) -> Column:
    """The mean of the token vectors whose mask isn't 0, weighted by it; zeros if there are none."""
    weighted = F.zip_with(tokens.cast("array<array<double>>"), _double(mask), lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(_double(F.element_at(tokens, 1)), lambda x: x * 0)
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    n = F.greatest(_sum(_double(mask)), F.lit(least))
    return F.transform(total, lambda x: x / n).cast("array<float>")


def cls_pooled(tokens: Column) -> Column:
    """The first token's vector."""
    return F.element_at(tokens, 1)


def position_ids(mask: Column, pad: int) -> Column:
    """pad + 1, pad + 2, ... over tokens whose mask isn't 0; pad elsewhere."""
    upto = lambda i: F.size(F.filter(F.slice(mask, 1, i + 1), lambda m: m != 0))
    return F.transform(mask, lambda m, i: F.when(m != 0, upto(i) + pad).otherwise(F.lit(pad)))


def relative_buckets(length: int, buckets: int = 32, most: int = 128) -> np.ndarray:
    """Bucket of each (query, key) distance: exact ones near by, logarithmic ones up to ``most``, each half of the sides."""
    half = buckets // 2
    exact = half // 2
    d = np.arange(length)[None, :] - np.arange(length)[:, None]
    far = np.maximum(np.abs(d), 1).astype(np.float64)
    wide = exact + np.trunc(np.log(far / exact) / log(most / exact) * (half - exact)).astype(np.int64)
    return (np.where(d > 0, half, 0) + np.where(np.abs(d) < exact, np.abs(d), np.minimum(wide, half - 1))).astype(np.int32)
