"""Benchmark decontamination: n-gram seeds find the places, Smith-Waterman alignment scores them.

The test items are split into blocks of bounded size; for each block, all documents are read once, and an item
is aligned wherever any of its word n-grams occurs. None is left out: what an edit leaves of an item may be its
most common n-grams, as those that the edit destroyed are the rarest. Places that hold too few of the item's
words for the least score are passed over before the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T

MATCH, OTHER, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, score double, seeds int, word_start long, word_end long"


def align(windows: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of item in each row of windows: score, ends (exclusive) in the row and in item."""
    rows, width = windows.shape
    step = np.arange(1, width + 1, dtype=np.int32)
    last = np.zeros((rows, width + 1), np.int32)
    best, col, at = np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i, w in enumerate(item):
        now = np.maximum(last[:, :-1] + np.where(windows == w, MATCH, OTHER).astype(np.int32), last[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - GAP * step, axis=1) + GAP * step
        last[:, 1:] = now
        j = now.argmax(axis=1)
        top = now[np.arange(rows), j]
        better = top > best
        best[better], col[better], at[better] = top[better], j[better] + 1, i + 1
    return best, col, at


class Seeds:
    """The n-grams of a block of items."""

    def __init__(self, ids: list, items: list[np.ndarray], n: int):
        self.ids, self.items, self.n = ids, items, n
        grams = [T.shingle_hashes(w, np.array([0, len(w)]), n)[0] if len(w) >= n else np.zeros(0, np.uint64) for w in items]
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        self.keys, self.key = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_inverse=True)
        self.order = np.argsort(self.key, kind="stable")
        self.first = np.searchsorted(self.key[self.order], np.arange(len(self.keys) + 1))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> T.U(44)).astype(np.int64)] = True
        # items of fewer words, by their number: hashes of the whole item, in order, and the items
        self.short = {}
        for k in range(1, n):
            at = np.array([i for i, w in enumerate(items) if len(w) == k], np.int64)
            if len(at):
                h = np.array([T.shingle_hashes(items[i], np.array([0, k]), k)[0][0] for i in at], np.uint64)
                self.short[k] = np.sort(h), at[np.argsort(h, kind="stable")]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in grams, key) of the known ones."""
        at = np.flatnonzero(self.sieve[(grams >> T.U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, grams[at]), max(0, len(self.keys) - 1))
        good = self.keys[k] == grams[at] if len(self.keys) else np.zeros(0, bool)
        return at[good], k[good]


def _slices(col: pa.Array, n: int) -> Iterator[tuple]:
    """(first row, words, their ranges, n-grams, the row and position of each) of slices of documents."""
    data, off = T.buffers(col)
    for a, b in T.slices(off):
        w, wo = T.word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], plain=True)
        g, go = T.shingle_hashes(w, wo, n)
        short = np.repeat(np.diff(wo) < n, np.diff(go))
        doc = np.repeat(np.arange(b - a), np.diff(go))
        pos = np.arange(len(g)) - go[doc]
        yield a, w, wo, g[~short], doc[~short], pos[~short]


def _parts(doc: np.ndarray, many: np.ndarray, most: int = 4_000_000) -> Iterator[slice]:
    """Ranges of hits that keep each document whole and come to about ``most`` of (hit, item)."""
    part = np.cumsum(many) // most
    part = part[np.searchsorted(doc, doc)]  # a document goes where its first hit goes
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for x, y in zip(cut, np.append(cut[1:], len(doc)), strict=True):
        yield slice(x, y)


def _align_part(out: dict, seeds: Seeds, least_score: float, size: np.ndarray, drift: np.ndarray, words: list[np.ndarray], a: int, w: np.ndarray, wo: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, many: np.ndarray) -> None:
    """Aligns items around hits (doc, pos, key); the best place of each (row, item) goes to out."""
    which = seeds.order[np.repeat(seeds.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    d, it = np.repeat(doc, many), seeds.item[which]
    diagonal = np.repeat(pos, many) - seeds.place[which]
    o = np.lexsort((diagonal, d, it))
    d, it, diagonal = d[o], it[o], diagonal[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (np.diff(diagonal) > size[it[1:]] // 2 + 4)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(d)) - 1
    n_words = np.diff(wo)[d[lo]]
    begin, end = np.maximum(0, diagonal[lo] - drift[it[lo]]), np.minimum(n_words, diagonal[hi] + size[it[lo]] + drift[it[lo]])
    groups = np.flatnonzero(np.diff(it[lo], prepend=-1))
    for x, y in zip(groups, np.append(groups[1:], len(lo)), strict=True):
        i = int(it[lo[x]])
        item = seeds.items[i]
        # what reaches least_score spans at most so many words: wide windows become tiles that overlap by as many
        span = int(size[i] + drift[i])
        tiles = np.maximum(1, -(-(end[x:y] - begin[x:y] - span) // (3 * span)))
        by = np.repeat(np.arange(x, y), tiles)
        tb = begin[by] + 3 * span * (np.arange(len(by)) - np.repeat(np.cumsum(tiles) - tiles, tiles))
        te = np.minimum(tb + 4 * span, end[by])
        order = np.argsort(te - tb, kind="stable")
        step = max(1, min(256, 500_000 // (4 * span)))
        for c0 in range(0, len(by), step):
            t = order[c0 : c0 + step]
            c, width = by[t], int((te - tb)[t].max())
            spot = tb[t][:, None] + np.arange(width)
            inside = spot < te[t][:, None]
            win = np.where(inside, w[np.minimum(wo[d[lo[c]]][:, None] + spot, len(w) - 1)], T.U(0))
            known = words[i][np.minimum(np.searchsorted(words[i], win), len(words[i]) - 1)] == win
            enough = np.flatnonzero(known.sum(axis=1) >= least_score * len(item))
            if not len(enough):
                continue
            c, t, win = c[enough], t[enough], win[enough]
            best, col_end, item_end = align(win, item)
            for k in np.flatnonzero(best >= least_score * MATCH * len(item)):
                back, length, _ = align(win[k : k + 1, : col_end[k]][:, ::-1], item[: item_end[k]][::-1])
                row, stop = a + int(d[lo[c[k]]]), int(tb[t[k]] + col_end[k])
                new_one = (float(best[k]) / (MATCH * len(item)), int(hi[c[k]] - lo[c[k]] + 1), stop - int(length[0]), stop)
                if (row, i) not in out or (new_one[0], -stop) > (out[row, i][0], -out[row, i][3]):
                    out[row, i] = new_one


def _found(col: pa.Array, seeds: Seeds, least_score: float) -> list[tuple]:
    """(row, item, score, seeds, first word, end word) of what reaches least_score; the best place of each item."""
    out: dict[tuple, tuple] = {}
    size = np.array([len(x) for x in seeds.items])
    drift = np.array([int(max(0.0, MATCH * n - least_score * MATCH * n) / -GAP) for n in size])  # what an alignment of least_score can gain in gaps
    words = [np.unique(x) for x in seeds.items]
    for a, w, wo, g, doc, pos in _slices(col, seeds.n):
        at, key = seeds.hits(g)
        many = seeds.first[key + 1] - seeds.first[key]
        for part in _parts(doc[at], many) if len(at) else ():
            _align_part(out, seeds, least_score, size, drift, words, a, w, wo, doc[at[part]], pos[at[part]], key[part], many[part])
        _whole_items(out, seeds, a, w, wo)
    return [(r, i, *x) for (r, i), x in sorted(out.items())]


def _whole_items(out: dict, seeds: Seeds, a: int, w: np.ndarray, wo: np.ndarray) -> None:
    """Items of fewer words than a seed, where a text holds them whole; one of a single word, where the text is that word."""
    for k, (hashes, items) in seeds.short.items():
        g, go = T.shingle_hashes(w, wo, k)
        many = np.diff(wo)
        doc = np.repeat(np.arange(len(many)), np.diff(go))
        lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
        for p in np.flatnonzero((hi > lo) & (many[doc] >= k) & ((k > 1) | (many[doc] == 1))):
            begin = int(p - go[doc[p]])
            for i in items[lo[p] : hi[p]]:
                out.setdefault((a + int(doc[p]), int(i)), (1.0, 1, begin, begin + k))


def seed_blocks(items: DataFrame, n: int = 3, words_a_block: int = 1_000_000) -> list[Seeds]:
    """The items (item_id, text, ...) in blocks of about ``words_a_block`` words, each with all its n-grams."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    blocks = max(1, -(-int(own.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * words_a_block)))
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = []
    for b in range(blocks):
        got = own.filter(F.col("block") == b).orderBy("item_id", "text").select("item_id", "text").toArrow()
        data, off = T.buffers(got.column("text"))
        w, wo = T.word_hashes(data, off, plain=True)
        out.append(Seeds(got.column("item_id").to_pylist(), [w[wo[i] : wo[i + 1]] for i in range(got.num_rows)], n))
    return out


def leaks(docs: DataFrame, items: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The pairs (doc_id, item_id) where a text of docs (doc_id, text, ...) holds a test item (item_id, text, ...).

    Words are lower-cased, ASCII punctuation counts as white space. score is the Smith-Waterman score of the
    best place (match 2, other word -1, gap -1) by that of an exact copy; pairs of at least least_score are
    returned, with the seeds met there and the place as word_start and word_end (exclusive). Every place with n
    of the item's words in a row is aligned, as far around as least_score allows; without such a run a pair is
    not found (3 words in a row fail if each third word is replaced, which scores about 0.5, or if a word is
    inserted after each second, which may score 0.75). Items of fewer than n words are found where a text holds
    them whole, those of one word where the text is that word alone; null and empty ones are never found. A null
    or empty text holds nothing. Of equal places the first counts. Other columns are not read.
    Rows that repeat an id are compared each by itself. Empty tables give an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for seeds in seed_blocks(items, **options):

        def find(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _found(batch.column(1), seeds, least_score)
                if rows:
                    r, i, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array([seeds.ids[x] for x in i], pa.int64()), pa.array(rest[0], pa.float64()), pa.array(rest[1], pa.int32()), pa.array(rest[2], pa.int64()), pa.array(rest[3], pa.int64())], ["doc_id", "item_id", "score", "seeds", "word_start", "word_end"])

        part = texts.mapInArrow(T.tidied(find), FOUND)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The rows of docs that hold no test item, as leaks finds them. The columns of docs; nothing is shuffled.

    Rows with a null or empty text stay, and so does every row where items is empty; each row is judged by its own
    text, whatever its id. An empty table gives an empty result.
    """
    place = docs.columns.index("text")
    out = docs
    for seeds in seed_blocks(items, **options):

        def keep(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[r for r, *_ in _found(batch.column(place), seeds, least_score)]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(T.tidied(keep), docs.schema)
    return out
