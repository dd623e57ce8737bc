"""Scores and their order: sigmoid, top-k overall and for each query, and checks of options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    """Single precision before any sorting: scores that saturate there are ties."""
    return (1 / (1 + F.exp(-logit.cast("double")))).cast("float")


def checked_top_k(k: int | None) -> int | None:
    if k is not None and k < 1:
        raise ValueError("top_k must be at least 1")
    return k


def resolved_batch(n: int, asked: int | None = None, default: int = 32) -> int:
    """The batch size for n inputs: what is asked for, which must not be 0, or at most the default. 0 inputs need none."""
    if n == 0:
        return 0
    if asked is not None and asked < 1:
        raise ValueError("batch_size must be at least 1")
    return asked or min(n, default)


def top_k(rows: DataFrame, score: str, index: str, k: int | None = None) -> DataFrame:
    """rows by falling score, ties by rising index; the first k of them."""
    out = rows.orderBy(F.col(score).desc(), F.col(index).asc())
    return out if checked_top_k(k) is None else out.limit(k)


def top_k_by(rows: DataFrame, key: str, score: str, index: str, k: int) -> DataFrame:
    """The first k rows of each key with their rank, from 1; Spark limits groups before the shuffle."""
    checked_top_k(k)
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(index).asc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
