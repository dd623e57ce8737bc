"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: So many parts the edges of one node are dealt to.
PARTS = 256


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(e: DataFrame) -> DataFrame:
    """u, v and m, the smallest v of u; edges of one u are dealt by v, so each task gets a part of a large node's.

    The parts' minima are joined into the node's, at most PARTS rows a node, and meet the edges by node and part.
    """
    e = e.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    parts = e.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.select("u", "part").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u")
    return e.join(least, ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Alternates large-star and small-star contraction (Kiveris et al., 2014). The edges of a node with very many
    neighbours are dealt to parts, for the minima and where these meet the edges, so no task gathers them.
    Edges with a null end and self-loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stored(e.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    seen = _print(e)
    while seen[0]:
        both = _with_least(e.union(e.select("v", "u")))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        e1 = stored(large.filter("u <> v").distinct(), "edges")
        moved = _with_least(e1)
        small = moved.select("u", F.col("m").alias("v")).union(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        e = stored(small.distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
