"""Chat formatting: of logged conversations that only grow, the maximal ones are kept and rendered.

A conversation's turns are hashed with their place, and prefixes are running exclusive-ors of these hashes.
A conversation whose whole hash is a proper prefix of another goes (an anti-join); of equal ones the smallest
id stays. Turns are dealt to ranges of their order, which part long conversations, and summed up by range first.
That two prefixes are equal is decided by 128 bits of hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def _hash(kind: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(kind), *[x for c in cols for x in (c.isNull(), c)])


def positioned(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, i (1, 2, ...), role, text, p1, p2 (hash of the turns up to i) of each distinct turn."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ("turn", "role", "text")
    t = stored(t.filter("conv_id is not null").distinct(), "distinct-turns")
    # a range is a chunk of a conversation, whatever its turns' numbers: null or equal ones, too, are parted by text
    t = t.repartitionByRange("conv_id", *order).withColumn("chunk", F.spark_partition_id())
    t = stored(t, "ranges")
    t = stored(t.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*order))), "turns")
    chunks = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("n")).drop("n")
    t = t.join(chunks, ["conv_id", "chunk"]).withColumn("i", F.col("before") + F.col("k"))
    t = t.withColumn("h1", _hash(1, F.col("i"), F.col("role"), F.col("text"))).withColumn("h2", _hash(2, F.col("text"), F.col("role"), F.col("i")))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    whole = whole.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")])
    t = t.withColumn("x1", F.bit_xor("h1").over(upto)).withColumn("x2", F.bit_xor("h2").over(upto)).join(whole, ["conv_id", "chunk"])
    return t.select("conv_id", "chunk", "i", "role", "text", F.col("x1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("p2"))


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that neither prefix a longer one nor repeat one of a smaller id."""
    whole = placed.groupBy("conv_id").agg(F.max("i").alias("n_turns"), F.max_by("p1", "i").alias("p1"), F.max_by("p2", "i").alias("p2"))
    own = whole.groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    inner = placed.select("conv_id", "i", "p1", "p2").join(whole.select("conv_id", "n_turns"), "conv_id").filter("i < n_turns")
    inner = inner.select("p1", "p2", F.col("i").alias("n_turns")).distinct()
    return own.join(inner, ["p1", "p2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def chat_documents(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, text: the maximal conversations of turns (conv_id, turn, role, text, ...), rendered whole.

    Turns are ordered by turn (null first), then role and text; exact repeats of a row count once. Turn numbers
    don't matter beyond the order. A row without conv_id belongs to no conversation. A turn is rendered as
    begin, role, line break, text, end, line break; a null role is ``unknown``, a null text empty, and ``<|`` in
    either becomes ``< |``. Ranges of a conversation are rendered first, then put together: one row a conversation,
    which is as long as its text. An empty table gives an empty result.
    """
    placed = stored(positioned(turns), "positions")
    keep = maximal(placed)
    safe = lambda c, other: F.replace(F.coalesce(F.col(c), F.lit(other)), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(begin), safe("role", "unknown"), F.lit("\n"), safe("text", ""), F.lit(f"{end}\n"))
    rows = placed.join(keep, "conv_id").select("conv_id", "n_turns", "chunk", "i", line.alias("line"))
    joined = lambda at, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c]), "")
    parts = rows.groupBy("conv_id", "n_turns", "chunk").agg(joined("i", "line").alias("part"))
    return parts.groupBy("conv_id", "n_turns").agg(joined("chunk", "part").alias("text"))
