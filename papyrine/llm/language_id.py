"""Language identification with one Bloom filter that is bit-sliced over languages.

Each position of the filter holds one bit for each language; the positions of an n-gram, and-ed, give all
languages that contain it. A document's n-grams are looked up, the bits of each language are counted,
corrected for the filter's false positives and for how much of its own text a language's n-grams cover,
and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from .scratch import stored

UNKNOWN = "und"
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalpha()]] = 32


@dataclass(frozen=True)
class LanguageFilter:
    """langs: sorted; words[w]: filter of the languages 64 w and on; fill, cover: of each language."""

    langs: list[str]
    n: int
    hashes: int
    words: list[np.ndarray]
    fill: np.ndarray
    cover: np.ndarray
    most_common: int


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 by 3; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _grams(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, packed n-grams of letters, their number in each row) for slices of the rows, in order.

    A text longer than a slice comes in several, each continuing where the one before ended.
    """
    data, off = T.buffers(pc.utf8_lower(col))
    for a, b in T.slices(off):
        for lo in range(int(off[a]), max(int(off[b]), int(off[a]) + 1), 4 * T.SLICE):
            hi = min(int(off[b]), lo + 4 * T.SLICE)
            more = min(int(off[b]), hi + n - 1)
            x = _BLANK[data[lo:more]]
            blank = x == 32
            keep = ~(blank & np.concatenate([[False], blank[:-1]]))
            edge = np.clip(off[a : b + 1] - lo, 0, len(x))
            keep[edge[:-1][edge[:-1] < len(x)]] = True
            at = np.concatenate([[0], np.cumsum(keep)])[edge]
            x = x[keep]
            if len(x) < n:
                yield a, np.zeros(0, np.uint64), np.zeros(b - a, np.int64)
                continue
            g = np.zeros(len(x) - n + 1, np.uint64)
            for i in range(n):
                g |= x[i : len(x) - n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
            doc = np.repeat(np.arange(b - a), np.diff(at))
            good = (doc[: len(g)] == doc[n - 1 :]) & ((x[: len(g)] & 0xC0) != 0x80)
            yield a, g[good], np.bincount(doc[: len(g)][good], minlength=b - a)


def fit(labelled: DataFrame, n: int = 5, docs_per_lang: int = 8000, least_rate: float = 2e-6, least_share: float = 0.2, hashes: int = 2, bits: int = 16) -> LanguageFilter:
    """Learns from the rows of (doc_id, text, lang) that have a text and a lang.

    docs_per_lang bounds the sample: about so many documents of each language, taken by a hash of the id.
    An n-gram belongs to a language where its rate is at least least_rate, and at least least_share of its highest
    rate in any language. So a language has at most 1 / least_rate n-grams, and the filter, which the driver gets
    as at most one row a position, at most 2 * bits / least_rate positions (16 million by default) of one byte for
    up to 8 languages, else of 8 bytes for each 64 languages, whatever the input.
    """
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = dict(rows.groupBy("lang").count().collect())
    langs = sorted(sizes, key=lambda s: s.encode())
    if not langs:
        return LanguageFilter([], n, hashes, [], np.zeros(0), np.zeros(0), 0)
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    share = F.lit(1_000_000)
    for k, v in sizes.items():
        if v > docs_per_lang:
            share = F.when(F.col("lang") == k, F.lit(1_000_000 * docs_per_lang // v)).otherwise(share)
    place = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(back, np.concatenate([p[1] for p in parts]))

        for batch in batches:
            own = np.array([place[x] for x in batch.column(0).to_pylist()])
            for a, g, per in _grams(batch.column(1), n):
                lang = np.repeat(own[a : a + len(per)], per)
                for i in np.unique(lang):
                    held.setdefault(int(i), []).append(np.unique(g[lang == i], return_counts=True))
                    if len(held[int(i)]) >= 64:
                        held[int(i)] = [merged(held[int(i)])]
        for i, parts in held.items():
            k, c = merged(parts)
            for j in range(0, len(k), 50_000):
                m = len(k[j : j + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(k[j : j + m].view(np.int64)), pa.array(np.full(m, i, np.int32)), pa.array(c[j : j + m].astype(np.int64))], ["gram", "lang", "n"])

    counts = stored(rows.filter(h < share).select("lang", "text").mapInArrow(T.tidied(count), "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    total = np.zeros(len(langs))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        total[r["lang"]] = r["n"]
    rate = F.col("n") / F.element_at(F.array(*[F.lit(max(float(t), 1.0)) for t in total]), F.col("lang") + 1)
    top = counts.withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("l"))  # at most a row a language
    kept = top.select("gram", "top", F.inline("l")).filter((F.col("rate") >= least_rate) & (F.col("n") >= 2) & (F.col("rate") >= least_share * F.col("top")))
    kept = stored(kept.select("gram", "lang", "n"), "kept-grams")
    cover, held = np.zeros(len(langs)), 0
    for r in kept.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect():
        cover[r["lang"]], held = r["n"] / max(total[r["lang"]], 1), max(held, r["grams"])
    size = 1 << max(10, int(np.ceil(np.log2(max(1, held) * bits))))  # each language has its own slice of bits: the fullest decides

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_numpy().astype(np.int64)
            for at in _places(batch.column(0).to_numpy().view(np.uint64), hashes, size):
                yield pa.RecordBatch.from_arrays([pa.array(lang // 64), pa.array(at), pa.array((T.U(1) << (lang % 64).astype(np.uint64)).view(np.int64))], ["word", "at", "mask"])

    got = kept.select("gram", "lang").mapInArrow(T.tidied(positions), "word long, at long, mask long").groupBy("word", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, at, mask = (got.column(i).to_numpy() for i in range(3))
    words = [np.zeros(size, np.uint8 if len(langs) <= 8 else np.uint64) for _ in range(-(-len(langs) // 64))]
    for w, table in enumerate(words):
        table[at[word == w]] = mask[word == w].view(np.uint64).astype(table.dtype)
    fill = np.array([((words[i // 64] >> words[0].dtype.type(i % 64)) & 1).mean() for i in range(len(langs))])
    return LanguageFilter(langs, n, hashes, words, fill, np.maximum(cover, 1e-3), max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def _places(grams: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    h = T.mix(grams + T._C[3])
    step = (h >> T.U(32)) | T.U(1)
    return [((h + T.U(i) * step) & T.U(size - 1)).astype(np.int64) for i in range(hashes)]


def hits(model: LanguageFilter, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the n-grams, and of these those in each language's filter."""
    out, seen = np.zeros((len(col), len(model.langs)), np.int64), np.zeros(len(col), np.int64)
    for a, g, per in _grams(col, model.n):
        rows = slice(a, a + len(per))
        seen[rows] += per
        full = np.flatnonzero(per)
        if not len(full):
            continue
        first = (np.cumsum(per) - per)[full]
        at = _places(g, model.hashes, len(model.words[0]))
        for w, table in enumerate(model.words):
            mask = table[at[0]]
            for p in at[1:]:
                mask = mask & table[p]
            for i in range(64 * w, min(len(model.langs), 64 * w + 64)):
                out[a + full, i] += np.add.reduceat(((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)).astype(np.int64), first)
    return out, seen


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, ...).

    lang_pred is a learned language: the one with the largest corrected count, the first by code point among
    equals, the most common one in training if no n-gram is known; ``und`` with score 0 for a text that is
    null or has no letter, or without any learned language. score is the decided language's part of all
    corrected counts, 0 to 1. Whole texts are read; no column but text takes part. An empty table gives an
    empty result.
    """
    fp, shared = model.fill**model.hashes, docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(2).fill_null("")
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            langs, score = [UNKNOWN] * len(text), np.zeros(len(text))
            if model.langs and len(text):
                got, seen = hits(model, text)
                c = np.maximum(0.0, (got - seen[:, None] * fp) / (1 - fp)) / model.cover
                best, total = c.argmax(axis=1), c.sum(axis=1)
                best[total == 0] = model.most_common
                score = np.where(letters & (total > 0), c[np.arange(len(c)), best] / np.maximum(total, 1e-300), 0.0)
                langs = [model.langs[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(T.tidied(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def fit_and_identify(docs: DataFrame, **options) -> DataFrame:
    """identify with what fit learns from the rows of docs that are not held out."""
    return identify(docs, fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), **options))


def identified_documents(docs: DataFrame, least_score: float = 0.35, **options) -> DataFrame:
    """The rows of docs whose text has a language: not und, and at least least_score sure. The columns of docs.

    A text with n-grams of which no filter knows any has score 0, as in identify; only a text without an n-gram is
    kept for its letters alone. The score is a share among the learned languages, so a text in another language
    that shares n-grams with one of them is kept.
    """
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), **options)
    fp, shared = model.fill**model.hashes, docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(place).fill_null("")
            good = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            if model.langs and len(text):
                got, seen = hits(model, text)
                c = np.maximum(0.0, (got - seen[:, None] * fp) / (1 - fp)) / model.cover
                total = c.sum(axis=1)
                score = np.where(total > 0, c.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                good = good & ((score >= least_score) | (seen == 0))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(T.tidied(keep), schema)
