"""Text expressions: Unicode white space, similarity, ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


def unicode_trim(c: Column) -> Column:
    """Without leading and trailing Unicode white space (Spark's trim knows the space only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def with_prompt(text: Column, prompt: Column | None = None) -> Column:
    """Trimmed text after the prompt, which is taken as it is."""
    return unicode_trim(text) if prompt is None else F.concat(prompt, unicode_trim(text))


def similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased, collapsed texts; 1 if both are empty, null if either is null."""
    a, b = collapse(F.lower(left)), collapse(F.lower(right))
    longest = F.greatest(F.length(a), F.length(b))
    same = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
    return F.when(left.isNotNull() & right.isNotNull(), same)


def concatenated(rows: DataFrame, key: str, order: list[str], text: str, separator: str = SEPARATOR) -> DataFrame:
    """key and its texts, joined in order; null texts are left out."""
    held = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x[text]), separator).alias(text))
