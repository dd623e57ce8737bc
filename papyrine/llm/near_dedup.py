"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. One pass hashes each text's distinct word shingles to a set digest, banded MinHashes and a signature.
   Documents of equal sets fall into one class; only its smallest id goes on, so copies cost nothing more.
2. Members of a band's bucket meet the bucket's two ends (never each other) and components are formed. Then
   members of different components that still share a bucket meet, all of them, without a cap: where very many
   are left in one bucket, by a second band; blocks of them pass by each other, so their pairs never become rows.
3. Each candidate pair's signatures are compared in batches; a pair is dropped once the posterior
   probability that its similarity reaches the threshold is under ``miss``. Survivors are confirmed on
   the full sets, recomputed from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from .components import connected_components
from .rows import numbered
from .scratch import stored

HASHES, BATCH = 320, 32
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"


def rows_per_band(threshold: float, hashes: int = HASHES, miss: float = 1e-5) -> int:
    """The most rows a band may have so that a pair at the threshold shares fewer than two bands with probability at most miss.

    One band is enough for a pair to meet, except in a hot bucket, whose members meet by a second one.
    """
    fewer = lambda p, n: (1 - p) ** n + n * p * (1 - p) ** (n - 1)
    return max(r for r in range(1, 17) if r == 1 or fewer(threshold**r, hashes // r) <= miss)


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches that keep a pair: P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum. Signatures
    hold a byte of each MinHash, so a pair of similarity s matches with probability s + (1 - s) / 256.
    """
    threshold += (1 - threshold) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def _families() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(7))
    return g.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1), g.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        h = x[None, i : i + 2048] * a
        h += b
        m = h.min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return low


def signatures(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    r = rows_per_band(threshold)
    bands = HASHES // r

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _families()
        c = T._C[:r]
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            keys = np.zeros((batch.num_rows, bands), np.int64)
            for i, s in T.shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(T.mix(s ^ T.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                if not len(s):
                    sig.append(b"")
                    continue
                low = minhash(s, a, b)
                sig.append(low.astype(np.uint8).tobytes())
                k = (low[: bands * r].reshape(bands, r).astype(np.uint64) * c).sum(axis=1, dtype=np.uint64)
                keys[i] = T.mix(k + T._BYTE[np.arange(bands)]).view(np.int64)
            size = np.where(np.array(n, np.int64) > 0, bands, 0)
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(off), pa.array(keys[size > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), col, pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.tidied(sign), SIGNED)


def _like(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of the signatures x and y stay plausible, compared batch after batch."""
    alive, hits = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        hits[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[hits[alive] >= m]
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, HASHES)


def plausible(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the threshold out."""
    least = least_matches(threshold, miss)
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = pa.array(_like(_matrix(batch.column(2)), _matrix(batch.column(3)), least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(T.tidied(compare), "a long, b long")


def joined_up(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs as a star for each set of ids that they connect: (a, b) with b the smallest, at most a row an id."""
    ids, at = np.unique(np.concatenate(pairs), return_inverse=True)
    at, root = at.reshape(-1, 2), np.arange(len(ids))
    while True:
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[at[:, 0]], low)
        np.minimum.at(new, root[at[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])


def dealt(members: DataFrame, held: int, streamed: int) -> DataFrame:
    """key, hold, stream, part, doc_id, comp, main: how members (key, doc_id, comp) of one key meet across components.

    A key's largest component (main) is never compared with itself. The members of the others are held (part 0),
    ``held`` at a time, while ``streamed`` of all members (part 1) pass by; no task gets a whole large key.
    """
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("n > most")
    keys = keys.select("key", "main", F.ceil((F.col("n") - F.col("most")) / held).cast("int").alias("holds"), F.ceil(F.col("n") / streamed).cast("int").alias("streams"))
    own = members.join(keys, "key")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    draw = lambda n: F.pmod(F.xxhash64("doc_id", "key"), n).cast("int")
    rows = own.filter("comp <> main").select("key", draw(F.col("holds")).alias("hold"), to(F.col("streams")).alias("stream"), F.lit(0).alias("part"), "doc_id", "comp", "main")
    return rows.union(own.select("key", to(F.col("holds")).alias("hold"), draw(F.col("streams")).alias("stream"), F.lit(1).alias("part"), "doc_id", "comp", "main"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(group, first row, first row of part 1, end) of rows (key, hold, stream, part, ...) in order."""
    k = [batch.column(i).to_numpy() for i in range(4)]
    group = np.stack(k[:3], axis=1)
    edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)])) if len(group) else np.zeros(0, np.int64)
    for lo, hi in zip(edge, np.append(edge[1:], len(group)), strict=True):
        yield tuple(group[lo]), lo, lo + int((k[3][lo:hi] == 0).sum()), hi


def by_second_band(members: DataFrame, reps: DataFrame, hot: int) -> DataFrame:
    """members (key, doc_id, comp), those of hot keys under keys made of theirs and of each other band of the member.

    Hot is a key with more than ``hot`` members outside its largest component: what they share is so common that it
    says little. A pair that shares another band meets under that pair of bands; rows_per_band makes sure of one.
    So the work on a hot key grows with its members and not with their square.
    """
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    large = by_comp.groupBy("key").agg((F.sum("n") - F.max("n")).alias("n")).filter(F.col("n") > hot).select("key")
    own = members.join(large, "key", "left_semi").join(reps.select("doc_id", "bands"), "doc_id")
    own = own.select("key", "doc_id", "comp", F.explode("bands").alias("band")).filter("band <> key").select(F.xxhash64("key", "band").alias("key"), "doc_id", "comp")
    own = stored(own, "second-bands")
    torn = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return members.join(large, "key", "left_anti").union(own.join(torn, "key").select("key", "doc_id", "comp"))


def plausible_clusters(members: DataFrame, sigs: DataFrame, num: int, den: int, miss: float, held: int = 512, streamed: int = 8192) -> DataFrame:
    """Clusters (node, root) of members (key, doc_id, comp) that plausible pairs of one bucket, but two components, connect.

    Pairs are compared where the bucket's signatures pass by and never become rows.
    """
    least = least_matches(num / den, miss)
    rows = dealt(members, held, streamed).join(sigs.select("doc_id", "sig", "n_shingles"), "doc_id").select("key", "hold", "stream", "part", "doc_id", "n_shingles", "comp", "main", "sig")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for batch in batches:
            ids, n, comp, main = (batch.column(i).to_numpy() for i in range(4, 8))
            sig = _matrix(batch.column(8))
            found = []
            for own, lo, mid, hi in _groups(batch):
                if own != key:
                    key, kept = own, []
                if mid > lo:
                    kept.append((ids[lo:mid], n[lo:mid], comp[lo:mid], sig[lo:mid]))
                if mid == hi or not kept:
                    continue
                hid, hn, hc, hs = (np.concatenate([h[i] for h in kept]) for i in range(4))
                step = max(1, 200_000 // len(hid))
                for c0 in range(mid, hi, step):
                    c = slice(c0, min(hi, c0 + step))
                    other = (hc[:, None] != comp[c]) & ((comp[c] == main[c]) | (hid[:, None] < ids[c]))
                    other &= np.minimum(hn[:, None], n[c]) * den >= np.maximum(hn[:, None], n[c]) * num
                    x, y = np.nonzero(other)
                    alive = _like(hs[x], sig[c][y], least)
                    found.append(np.stack([hid[x[alive]], ids[c][y[alive]]], axis=1))
            if sum(map(len, found)):
                yield joined_up(found)

    pairs = rows.repartition("key", "hold", "stream").sortWithinPartitions("key", "hold", "stream", "part").mapInArrow(T.tidied(compare), "a long, b long")
    return connected_components(pairs, "a", "b")


def confirmed_in_clusters(members: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, held: int = 256, streamed: int = 8192) -> DataFrame:
    """Stars (a, b) of the links between members (key, doc_id, comp) of one cluster but two components, on full sets.

    The held texts' shingles are indexed; each text that passes by is counted against all of them at once.
    """
    rows = _texts(docs).join(stored(dealt(members, held, streamed), "asked").hint("merge"), "doc_id").select("key", "hold", "stream", "part", "doc_id", "comp", "main", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, index = None, [], None
        for batch in batches:
            ids, comp, main = (batch.column(i).to_numpy() for i in range(4, 7))
            sets = [x for _, x in T.shingle_sets(batch.column(7), shingle)]
            found = []
            for own, lo, mid, hi in _groups(batch):
                if own != key:
                    key, kept, index = own, [], None
                kept += [(ids[i], comp[i], sets[i]) for i in range(lo, mid)]
                if mid == hi or not kept:
                    continue
                if index is None or mid > lo:
                    size = np.array([len(x) for *_, x in kept])
                    every = np.concatenate([x for *_, x in kept])
                    order = np.argsort(every, kind="stable")
                    index = every[order], np.repeat(np.arange(len(kept)), size)[order], size, np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
                every, whose, size, hid, hc = index
                for i in range(mid, hi):
                    a, b = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
                    n = b - a
                    common = np.bincount(whose[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=len(size))
                    good = (den * common >= num * (size + len(sets[i]) - common)) & (hc != comp[i]) & ((comp[i] == main[i]) | (hid < ids[i]))
                    if good.any():
                        found.append(np.stack([hid[good], np.full(int(good.sum()), ids[i])], axis=1))
            if found:
                yield joined_up(found)

    return rows.repartition("key", "hold", "stream").sortWithinPartitions("key", "hold", "stream", "part").mapInArrow(T.tidied(confirm), "a long, b long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, fan: int = 256) -> DataFrame:
    """The pairs (a, b) with den * |A and B| >= num * |A or B| on their full shingle sets.

    Texts are sent once per request; an a with many partners is dealt to one task for each ``fan`` of them.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).alias("shares"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr("pmod(xxhash64(b), shares)").alias("share"))
    asked = dealt.select(F.col("b").alias("doc_id"), "a", "share", F.lit(1).alias("part"))
    asked = asked.union(dealt.select(F.col("a").alias("doc_id"), "a", "share", F.lit(0).alias("part")).distinct())
    asked = stored(asked, "asked")
    rows = _texts(docs).join(asked.hint("merge"), "doc_id").select("a", "share", "part", "doc_id", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = key = None
        for batch in batches:
            a, share, part, ids = (batch.column(k).to_numpy() for k in range(4))
            good = []
            for i, s in T.shingle_sets(batch.column(4), shingle):
                if part[i] == 0:
                    own, key = s, (a[i], share[i])
                elif key == (a[i], share[i]) and len(s) and len(own):
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    common = int((own[at] == s).sum())
                    if den * common >= num * (len(own) + len(s) - common):
                        good.append(i)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(ids[good])], ["a", "b"])

    return rows.repartition("a", "share").sortWithinPartitions("a", "share", "part").mapInArrow(T.tidied(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6, hot: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. A text of fewer words than ``shingle`` is one
    shingle; a null, empty or blank text has none and is linked with nothing. Pairs with
    ``den * |A and B| >= num * |A or B|`` are linked; component_id is the smallest doc_id reachable and
    kept marks it. Ids should be unique: rows that repeat an id share its component; a row without an id
    takes the component of the smallest id with the same set (null and kept if there is none).
    Other columns are not read. An empty table gives an empty result.
    """
    threshold = num / den
    sigs = stored(signatures(docs, shingle, threshold), "signatures")
    full = sigs.filter("n_shingles > 0")
    classes = stored(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id"])
    reps = stored(reps.select("doc_id", "n_shingles", "bands", "sig"), "representatives")
    size_fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num

    # each member of a bucket with the bucket's two ends
    members = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min(F.struct("b", "nb")).alias("lo"), F.max(F.struct("b", "nb")).alias("hi")).filter("lo.b <> hi.b")
    met = members.join(ends, "key").select("b", "nb", F.explode(F.array("lo", "hi")).alias("end"))
    met = met.filter((F.col("end.b") != F.col("b")) & size_fits(F.col("nb"), F.col("end.nb")))
    met = met.select(F.col("end.b").alias("a"), "b").distinct()
    first = stored(plausible(met, reps, threshold, miss), "candidates")
    links = stored(confirmed(first, docs, shingle, num, den), "links")
    comp = stored(connected_components(links, "a", "b"), "components")

    # members of one bucket that are in different components still
    own = reps.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("comp"), "bands")
    members = own.select("doc_id", "comp", F.explode("bands").alias("key"))
    torn = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    members = stored(members.join(torn, "key").select("key", "doc_id", "comp"), "torn")
    members = stored(by_second_band(members, reps, hot), "torn")
    clusters = plausible_clusters(members, reps, num, den, miss)
    members = clusters.select(F.col("root").alias("key"), F.col("node").alias("doc_id")).join(own.select("doc_id", "comp"), "doc_id")
    more = stored(confirmed_in_clusters(stored(members, "clusters"), docs, shingle, num, den), "links")
    comp = connected_components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b") if more.head(1) else comp

    # every row with its class, and the class with its component
    classes = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, ...), one of each component of near_duplicates. The columns of docs.

    Rows are taken one by one, whatever their ids: of rows that repeat an id or have none one stays, too, if their
    texts are linked. The row of the smallest id stays; without an id only if no row of its component has one; of
    rows that repeat that id any one, the same in each run over the same files. A null, empty or blank text is linked with nothing and
    stays, as does each text under the same id that is linked with no other. An empty table gives an empty result.
    """
    own = numbered(docs)
    id_ = F.col("row.doc_id").cast("long")
    found = near_duplicates(own.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")), **options).select(F.col("doc_id").alias("uid"), "component_id")
    ids = own.select("uid", F.struct(id_.isNull().alias("unknown"), id_.alias("id"), "uid").alias("rank"))
    keep = found.join(ids, "uid").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.uid")
    return own.join(keep, "uid", "left_semi").select("row.*")
