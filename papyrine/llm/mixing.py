"""Mixing sources to target weights along a time-varying curriculum.

Targets: weights share a budget, no target exceeds ``most`` times its source's size, and the excess is shared
again by weight. Order: each source has a schedule of relative weight over training time; its documents'
cumulative token demand is inverted through the schedule's integral, which gives each copy of a document its
training position, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import numbered
from .scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: (time, relative weight) knots: falling, level, rising; dealt to sources in turn.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: A mix's order; what follows the position parts copies that fall due at the same time.
ORDER = ("position", "rank", "doc_id", "size", "copy", "uid")


def _inverse(demand: Column, knots: tuple) -> Column:
    """Time by which a schedule has asked for the part ``demand`` of all that it asks for."""
    area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, out, done = sum(area), F.lit(float(knots[-1][0])), sum(area)
    for ((t0, w0), (t1, w1)), own in reversed(list(zip(zip(knots, knots[1:]), area))):
        done -= own
        rest = F.greatest(demand * total - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        t = rest / F.lit(float(w0)) if not slope else (F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w0 * w0)) + rest * (2 * slope))) - w0) / slope
        out = F.when(demand * total <= F.lit(done + own), F.lit(float(t0)) + F.least(t, F.lit(float(t1 - t0)))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """source, rank, weight, source_size, target for each source of sizes (source, size).

    Sources are ranked by code point, null last; weights repeat. With caps c = most * size and weights w the
    targets are min(w * level, c), where level makes them add up to the budget: sources are capped in the
    order of c / w.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("rank", F.row_number().over(by_name) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    own = own.withColumn("budget", F.sum("source_size").over(everything).cast("double") * budget)
    own = own.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    spent = F.coalesce(F.sum(F.col("source_size") * most).over(earlier), F.lit(0)).cast("double")
    own = own.withColumn("here", (F.col("budget") - spent) / rest)
    # the first source that its cap doesn't hold sets the level of all that follow
    own = own.withColumn("level", F.min(F.when(F.col("ratio") > F.col("here"), F.struct("ratio", "rank", "here"))).over(everything)["here"])
    own = own.withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    return own.select("source", "rank", "weight", "source_size", "target")


def _plan(docs: DataFrame, weights: tuple, budget: float, most: int) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, rank, before, copies for each row of docs (uid, doc_id, text, source)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    rows = stored(rows, "sizes")
    targets = source_targets(rows, weights, budget, most)
    targets = stored(targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("extra", F.col("target") - F.col("full") * F.col("source_size")), "targets")
    # ranges of the order, which part any source and any id: sums of the ranges, then sums within each
    order = ("key", "doc_id", "size", "uid")
    rows = stored(rows.repartitionByRange("source", *order).withColumn("range", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))  # a row a range, and one more for each source
    ranges = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n"))
    ranges = ranges.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "range", "before", "rank", "source_size", "target", "full", "extra")
    inner = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("upto", F.sum("size").over(inner) - F.col("size"))
    own = own.alias("d").join(ranges.alias("s"), F.expr("d.source <=> s.source and d.range = s.range")).select("d.uid", "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.rank", "s.full", "s.extra", (F.col("d.upto") + F.col("s.before")).alias("before"))
    more = F.col("before") + F.col("size") / 2 < F.col("extra")
    own = own.withColumn("copies", (F.col("full") + F.when(more, 1).otherwise(0)).cast("int"))
    return own.drop("full", "extra")


def _copies(plan: DataFrame, schedules: tuple) -> DataFrame:
    """ORDER's columns of each copy that plan takes: the demand of every one is inverted through its source's schedule."""
    out = plan.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    demand = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    demand = F.least(demand, F.lit(1.0))
    t = _inverse(demand, schedules[0])
    for k in range(1, len(schedules)):
        t = F.when(F.col("rank") % len(schedules) == k, _inverse(demand, schedules[k])).otherwise(t)
    return out.withColumn("position", t).select(*ORDER)


def _range_sorted(copies: DataFrame) -> DataFrame:
    return copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, most: int = 2, schedules: tuple = SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, first_position, last_position, first_start of each row of docs (doc_id, text, source, ...).

    size counts the words of the whole text, 0 without one. A source's documents are ordered by the MD5 of
    the id. With target = k * source_size + r, each is taken k times, and the first ones once more until
    their words come nearest to r. A position is the training time, 0 to 1, at which a copy's middle falls due.
    The copies are written to the shared folder range-sorted by position; taken (their words), copies, positions
    and first_start (the mix's words before the first copy) are read back from there, the last three null if
    there is none. Sources of no words have target 0; an empty table gives an empty result; rows that repeat an
    id are mixed each for itself, the smaller first, and a null id sorts as an empty text. Sums run over ranges
    of an order, which part sources and ids, so no task holds a whole one.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(c) for c in ("doc_id", "text", "source")])
    plan = stored(_plan(rows, weights, budget, most), "plan")
    copies = stored(_range_sorted(_copies(plan, schedules)).withColumn("range", F.spark_partition_id()), "mix")
    ranges = copies.groupBy("range").agg(F.sum("size").alias("n"))  # a row a range
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("earlier"))
    inner = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("upto", F.sum("size").over(inner) - F.col("size")).join(ranges, "range").withColumn("start", F.col("upto") + F.col("earlier"))
    own = copies.groupBy("uid").agg(F.sum("size").alias("taken"), F.count("*").cast("int").alias("copies"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.min("start").alias("first_start"))
    out = plan.drop("copies").join(own, "uid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source", F.coalesce("copies", F.lit(0)).alias("copies"), "first_position", "last_position", "first_start")


def mixed_documents(docs: DataFrame, weights: tuple = (3, 1, 2), budget: float = 1.5, most: int = 2, schedules: tuple = SCHEDULES) -> DataFrame:
    """The rows of docs as often as mix takes them, range-sorted by training position. The columns of docs.

    Each row is taken by its own plan, whatever its id, and each copy stands at its own position. A row without
    words has a size of 0 and is taken as mix says. An empty table gives an empty result.
    """
    own = numbered(docs)
    plan = _plan(own.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source")), weights, budget, most)
    return _range_sorted(own.join(_copies(plan, schedules), "uid")).select("row.*")
