"""What an extraction returns: parts, canonical text, audit steps, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOX, PART, PARTS, PROVENANCE, STEP, STEPS, null
from .text import SEPARATOR, unicode_trim


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")).cast(BOX)


def provenance(page: Column | None = None, bbox: Column | None = None, confidence: Column | None = None) -> Column:
    pick = lambda c, kind: null(kind) if c is None else c
    return F.struct(pick(confidence, "float").alias("confidence"), pick(page, "bigint").alias("page"), pick(bbox, BOX).alias("bbox")).cast(PROVENANCE)


def part(index: Column, kind: Column, text: Column, origin: Column | None = None) -> Column:
    return F.struct(index.alias("index"), kind.alias("kind"), text.alias("text"), (null(PROVENANCE) if origin is None else origin).alias("provenance")).cast(PART)


def single_part(text: Column) -> Column:
    """One text part without provenance."""
    return F.array(part(F.lit(0), F.lit("text"), text)).cast(PARTS)


def without_blank_parts(parts: Column) -> Column:
    """Parts with a text other than white space, numbered anew from 0."""
    some = F.filter(parts, lambda p: F.coalesce(unicode_trim(p["text"]) != "", F.lit(False)))
    return F.transform(some, lambda p, i: part(i, p["kind"], p["text"], p["provenance"])).cast(PARTS)


def canonical_text(canonical: Column, parts: Column) -> Column:
    """The canonical text, even an empty one; else the parts' texts parted by blank lines, null if that is empty."""
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return F.coalesce(canonical, F.nullif(F.array_join(texts, SEPARATOR), F.lit("")))


def has_text(canonical: Column, parts: Column) -> Column:
    return canonical_text(canonical, parts).isNotNull()


def step(kind: str | Column, engine: Column, outputs: dict[str, Column], duration_ms: Column | None = None) -> Column:
    """An audit step; outputs are sorted by name. Its duration isn't part of any comparison."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    counts = F.create_map(*[x for k in sorted(outputs) for x in (F.lit(k), outputs[k].cast("bigint"))])
    return F.struct(kind.alias("step"), engine.alias("engine"), (F.lit(0) if duration_ms is None else duration_ms).alias("duration_ms"), counts.alias("outputs")).cast(STEP)


def steps(*some: Column) -> Column:
    """The steps that aren't null."""
    return F.filter(F.array(*some).cast(STEPS), lambda s: s.isNotNull())


def as_json(result: Column, pretty: bool = False) -> Column:
    """JSON without null fields."""
    return F.to_json(result, {"pretty": "true"} if pretty else {})
