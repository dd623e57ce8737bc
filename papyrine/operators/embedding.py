"""Text embedding: one unit vector for each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import resolved_batch
from ..functions.text import with_prompt
from ..providers import TextEncoder, loaded


def embed(rows: DataFrame, model: TextEncoder, text: str = "text", prompt: str | None = None, batch: int | None = None, out: str = "embedding") -> DataFrame:
    """rows with a vector of each text, trimmed and after the prompt, which is not; null for null.

    Texts of a batch are taken by length, so that little is padding; the model is opened once for each worker.
    """
    if batch is not None:
        resolved_batch(1, batch)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = loaded(model)
        for part in parts:
            found = pd.Series([None] * len(part), dtype=object)
            live = [i for i, t in enumerate(part) if t is not None]
            live.sort(key=lambda i: len(part.iloc[i]))
            size = resolved_batch(len(live), batch)
            for k in range(0, len(live), max(1, size)):
                some = live[k : k + size]
                v = np.asarray(encoder.vectors([part.iloc[i] for i in some]), np.float32)
                if len(v) != len(some):
                    raise ValueError("the model gave another number of vectors than it got texts")
                for i, x in zip(some, v, strict=True):
                    found.iloc[i] = x
            yield found

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    ready = with_prompt(F.col(text), None if prompt is None else F.lit(prompt))
    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(ready))
