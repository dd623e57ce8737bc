"""Exact top-k inner products by distributed histogram selection.

Queries and rows are dealt to tasks in blocks of bounded size. Every row is scored in each round; rounds
narrow down, for each query, the range that holds its k-th score by global histograms of the scores in that
range. Then all rows of at least the k-th score are taken, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as T
from .scratch import stored

BINS = 1024
EXACT = 2.0**53
LEAST = -(2**63), 2**63 - 1


def quantized(col: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and floor(scale * x) of each as whole doubles; null and non-finite ones do not."""
    rows, out = [], []
    flat = col.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.array([0 if n is None else n for n in pc.list_value_length(col).to_pylist()], np.int64)
    null = col.is_null().to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    whole = np.floor(values * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values) | ~np.isfinite(whole))])
    for i in np.flatnonzero(~null & (bad[end] == bad[end - size])):
        rows.append(i)
        out.append(whole[end[i] - size[i] : end[i]])
    return np.array(rows, np.int64), out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, exact; those beyond 64 bits are held at their ends."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _dealt(rows: DataFrame, asked: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Each block of queries with each part of the rows: block, part, kind (0 query, 1 row), id, v, lo, hi, left; sorted.

    A query meets every part and a row every block, as in a blocked matrix product; what a task gets is bounded by
    a block and a part. lo, hi and left are the query's range and rank in it.
    """
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("block", to(parts).alias("part"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "v", "lo", "hi", "left")
    r = rows.select(to(blocks).alias("block"), "part", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", *[F.lit(None).cast("long").alias(c) for c in ("lo", "hi", "left")])
    return q.union(r).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "id")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch | None]]:
    """(first of its query block, ids, vectors, (lo, hi, left) of the queries; rows of one length): queries held, rows stream by."""
    held, key, ended = [], None, False
    for batch in batches:
        block, part, kind = (batch.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])) if len(block) else []
        for lo, hi in zip(edge, [*edge[1:], len(block)], strict=True):
            some = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                if key != (block[lo], part[lo]) or ended:
                    held, key, ended = [], (block[lo], part[lo]), False
                held.append(some)
            elif key == (block[lo], part[lo]):
                yield not ended, pa.Table.from_batches(held), some
                ended = True


def _matrices(t: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors as a matrix, by length."""
    col = t.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size, flat, out = pc.list_value_length(col).to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False), {}
    begin = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out[int(d)] = at, flat[begin[at][:, None] + np.arange(d)]
    return out


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(new query block?, queries' ids and ranges, numbers of the queries scored, ids of rows, scores, whether another row) by slices."""
    for first, q, rows in _tasks(batches):
        ids, limits = q.column("id").to_numpy(), [q.column(c).to_numpy() for c in ("lo", "hi", "left")]
        asked, cand = _matrices(q), rows.column(3).to_numpy()
        if first:
            yield True, ids, limits, None, None, None, None
        for d, (at, mat) in _matrices(rows).items():
            if d in asked:
                qa, qm = asked[d]
                for j in range(0, len(qa), 512):
                    other = ids[qa[j : j + 512]][:, None] != cand[at][None]
                    yield False, ids, limits, qa[j : j + 512], cand[at], _scores(qm[j : j + 512], mat), other


def _over_tasks(start, add, end):  # noqa: ANN001, ANN202
    """A function of batches: start(ids, limits) for each task of a block and a part, add for each slice, end for its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for first, ids, limits, q, c, s, other in _scored(batches):
            if first:
                if state is not None:
                    yield end(state)
                state = start(ids, limits)
            else:
                add(state, q, c, s, other)
        if state is not None:
            yield end(state)

    return run


def _range_rows():  # noqa: ANN202
    def start(ids: np.ndarray, limits: list) -> dict:
        return {"ids": ids, "n": np.zeros(len(ids), np.int64), "lo": np.full(len(ids), LEAST[1], np.int64), "hi": np.full(len(ids), LEAST[0], np.int64)}

    def add(x: dict, q: np.ndarray, c: np.ndarray, s: np.ndarray, other: np.ndarray) -> None:
        x["n"][q] += other.sum(axis=1)
        x["lo"][q] = np.minimum(x["lo"][q], np.where(other, s, LEAST[1]).min(axis=1))
        x["hi"][q] = np.maximum(x["hi"][q], np.where(other, s, LEAST[0]).max(axis=1))

    def end(x: dict) -> pa.RecordBatch:
        at = np.flatnonzero(x["n"])
        return pa.RecordBatch.from_arrays([pa.array(x[c][at]) for c in ("ids", "n", "lo", "hi")], ["query_id", "n", "lo", "hi"])

    return _over_tasks(start, add, end)


def _width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the bins between lo and hi; differences may take all 64 bits."""
    return np.maximum(T.U(1), (hi.view(np.uint64) - lo.view(np.uint64)) // T.U(BINS) + T.U(1))


def _histogram_rows():  # noqa: ANN202
    def start(ids: np.ndarray, limits: list) -> dict:
        lo, hi, left = (np.ascontiguousarray(x, np.int64) for x in limits)
        return {"ids": ids, "lo": lo, "hi": hi, "left": left, "width": _width(lo, hi), "held": np.zeros((len(ids), BINS), np.int32)}

    def add(x: dict, q: np.ndarray, c: np.ndarray, s: np.ndarray, other: np.ndarray) -> None:
        r, k = np.nonzero(other & (s >= x["lo"][q][:, None]) & (s <= x["hi"][q][:, None]))
        bins = ((s[r, k].view(np.uint64) - x["lo"][q][r].view(np.uint64)) // x["width"][q][r]).astype(np.int64)
        x["held"][q] += np.bincount(r * BINS + bins, minlength=len(q) * BINS).reshape(len(q), BINS).astype(np.int32)

    def end(x: dict) -> pa.RecordBatch:
        # bins under this part's own left-th score can't hold the one of all parts
        above = np.cumsum(x["held"][:, ::-1], axis=1)[:, ::-1] - x["held"]
        r, k = np.nonzero((x["held"] > 0) & (above < x["left"][:, None]))
        lo = x["lo"][r] + (k.astype(np.uint64) * x["width"][r]).view(np.int64)
        hi = np.minimum(x["hi"][r].view(np.uint64) - x["lo"][r].view(np.uint64), (k + 1).astype(np.uint64) * x["width"][r] - T.U(1)) + x["lo"][r].view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x["ids"][r]), pa.array(k.astype(np.int64)), pa.array(lo), pa.array(hi.view(np.int64)), pa.array(x["held"][r, k].astype(np.int64))], ["query_id", "bin", "lo", "hi", "n"])

    return _over_tasks(start, add, end)


def _chosen_rows():  # noqa: ANN202
    def start(ids: np.ndarray, limits: list) -> dict:
        return {"ids": ids, "kth": limits[0], "left": limits[2], "over": [], "equal": {}}

    def add(x: dict, q: np.ndarray, c: np.ndarray, s: np.ndarray, other: np.ndarray) -> None:
        r, k = np.nonzero(other & (s > x["kth"][q][:, None]))
        x["over"].append((x["ids"][q[r]], c[k], s[r, k]))
        r, k = np.nonzero(other & (s == x["kth"][q][:, None]))
        for i in np.unique(r):
            g = int(q[i])
            x["equal"][g] = np.sort(np.concatenate([x["equal"].get(g, np.zeros(0, np.int64)), c[k[r == i]]]))[: x["left"][g]]

    def end(x: dict) -> pa.RecordBatch:
        over = x["over"] + [(np.full(len(c), x["ids"][g]), c, np.full(len(c), x["kth"][g])) for g, c in x["equal"].items()]
        q, c, s = (np.concatenate([np.zeros(0, np.int64), *[o[i] for o in over]]).astype(np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    return _over_tasks(start, add, end)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 2048, part: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, embedding, ...) with the highest scores.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of another id. Components
    count as floor(scale * x); the score is their integer inner product, ties go to the smaller id. Vectors that
    are null or hold a null or non-finite component take no part, nor do rows without an id; only vectors of
    one length are compared. Of queries that repeat an id the least vector counts; candidates that repeat one
    count each. With fewer than k candidates all are returned. An empty table gives an empty result.

    Vectors are quantised once, into a stored table. About ``block`` queries and ``part`` rows meet in one task;
    ranges and histograms are tables, and the driver loops over rounds only, whatever the number of queries.
    """

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vec = quantized(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(vec, pa.list_(pa.float64()))], ["vec_id", "v"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    own = stored(own.mapInArrow(T.tidied(quantise), "vec_id long, v array<double>").withColumn("at", F.monotonically_increasing_id()), "quantised")
    parts = max(1, -(-own.count() // part))
    rows = own.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int"))
    asked = own.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = stored(asked.withColumns({c: F.lit(None).cast("long") for c in ("lo", "hi", "left")}), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    met = lambda asked, f, kind: _dealt(rows, asked, blocks, parts).mapInArrow(T.tidied(f), kind)
    got = met(asked, _range_rows(), "query_id long, n long, lo long, hi long").groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.least(F.lit(k), F.sum("n")).alias("left"))
    asked = stored(asked.drop("lo", "hi", "left").join(got, "query_id").select("query_id", "v", "lo", "hi", "left", "block"), "ranges")
    while asked.filter("lo < hi").head(1):  # left-th largest within lo to hi is the k-th of all
        open_ = asked.filter("lo < hi")
        bins = met(open_, _histogram_rows(), "query_id long, bin long, lo long, hi long, n long").groupBy("query_id", "bin", "lo", "hi").agg(F.sum("n").alias("n"))
        bins = bins.withColumn("above", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bin").desc())) - F.col("n"))
        at = bins.join(open_.select("query_id", F.col("left").alias("rank")), "query_id").filter("above < rank and rank <= above + n").select("query_id", "lo", "hi", (F.col("rank") - F.col("above")).alias("left"))
        asked = stored(open_.select("query_id", "v", "block").join(at, "query_id").select("query_id", "v", "lo", "hi", "left", "block").union(asked.filter("lo >= hi")), "ranges")
    found = met(asked, _chosen_rows(), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
