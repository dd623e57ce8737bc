"""Reranking: scores of (query, document) pairs, sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import checked_top_k, resolved_batch, sigmoid, top_k, top_k_by
from ..providers import CrossEncoder, loaded


def score(pairs: DataFrame, model: CrossEncoder, query: str = "query", document: str = "document", batch: int | None = None, out: str = "score") -> DataFrame:
    """pairs with a logit of each; null where either side is null."""
    if batch is not None:
        resolved_batch(1, batch)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = loaded(model)
        for q, d in parts:
            found, live = pd.Series([None] * len(q), dtype=object), np.flatnonzero((q.notna() & d.notna()).to_numpy())
            size = resolved_batch(len(live), batch)
            for k in range(0, len(live), max(1, size)):
                some = live[k : k + size]
                s = np.asarray(scorer.scores([(q.iloc[i], d.iloc[i]) for i in some]), np.float32)
                if len(s) != len(some):
                    raise ValueError("the model gave another number of scores than it got pairs")
                found.iloc[some] = s
            yield found.astype("float32")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pairs.withColumn(out, F.pandas_udf(run, "float")(query, document))


def rerank(documents: DataFrame, query: str, model: CrossEncoder, document: str = "document", index: str = "index", k: int | None = None, normalize: bool = False, batch: int | None = None) -> DataFrame:
    """documents by falling score for one query, ties by index; with normalize the scores are sigmoids, taken before sorting."""
    checked_top_k(k)
    rows = score(documents.withColumn("_query", F.lit(query)), model, "_query", document, batch).drop("_query")
    return top_k(rows.withColumn("score", sigmoid(F.col("score"))) if normalize else rows, "score", index, k)


def rerank_by(pairs: DataFrame, model: CrossEncoder, key: str, k: int, query: str = "query", document: str = "document", index: str = "index", normalize: bool = False, batch: int | None = None) -> DataFrame:
    """The k best documents of each query of a table of pairs, with their rank."""
    checked_top_k(k)
    rows = score(pairs, model, query, document, batch)
    return top_k_by(rows.withColumn("score", sigmoid(F.col("score"))) if normalize else rows, key, "score", index, k)
