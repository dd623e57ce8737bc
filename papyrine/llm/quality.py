"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Votes are counted by pattern over all
documents, expectation-maximisation estimates each labeller's accuracy and the classes' shares from these
counts, and the posterior labels train a linear scorer on hashed words and word shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T

LABELLERS = ("symbols", "capitals", "repeated_lines", "length", "short_words", "word_length", "sentences", "separators")
DIMS = 1 << 16
_b = np.arange(256)
_UPPER, _DIGIT = (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57)
_LETTER = _UPPER | ((_b >= 97) & (_b <= 122)) | (_b >= 0xC0)
_MARK = (_b < 128) & (_b > 32) & ~_LETTER & ~_DIGIT & ~np.isin(_b, [ord(c) for c in ".,;:'\"-()!?"])
_SHAPE = np.where(_UPPER, 65, np.where(_DIGIT, 48, np.where((_b >= 97) & (_b <= 122) | (_b >= 128), 97, _b))).astype(np.uint8)


def votes(col: pa.Array) -> np.ndarray:
    """Votes of LABELLERS on each text: 0 bad, 1 good, 2 nothing; (rows, labellers)."""
    data, off = T.buffers(col)
    out = np.full((len(off) - 1, len(LABELLERS)), 2, np.int8)
    for a, b in T.slices(off):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]

        def count(table: np.ndarray, d: np.ndarray = d, o: np.ndarray = o) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(table[d])])[o])

        def vote(k: int, bad: np.ndarray, good: np.ndarray, a: int = a, b: int = b) -> None:
            out[a:b, k] = np.where(bad, 0, np.where(good, 1, 2))

        inside = ~T._SPACE[d]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[o[:-1][o[:-1] < o[1:]]] |= inside[o[:-1][o[:-1] < o[1:]]]
        starts, kept = np.flatnonzero(first), np.flatnonzero(inside)
        size = np.diff(np.append(np.searchsorted(kept, starts), len(kept)))
        wo = np.searchsorted(starts, o)
        words = np.diff(wo).astype(float)
        some, total = np.maximum(words, 1), np.maximum(np.diff(o), 1)
        short = np.diff(np.concatenate([[0], np.cumsum(size <= 3)])[wo])
        letters = count(_LETTER)
        caps = count(_UPPER) / np.maximum(letters, 1)
        marks = count(_MARK) / total
        mean = count(~T._SPACE) / some
        ends = count(np.isin(_b, [46, 33, 63])) / some
        bars = count(np.isin(_b, [124, 9])) / some
        vote(0, marks > 0.04, marks < 0.004)
        vote(1, caps > 0.4, (caps < 0.15) & (letters > 20))
        vote(3, words < 5, (words >= 40) & (words <= 50_000))
        vote(4, (short / some < 0.06) & (words >= 10), (short / some > 0.15) & (short / some < 0.7) & (words >= 10))
        vote(5, (mean > 11) | (mean < 2.5), (mean > 3.5) & (mean < 8))
        vote(6, (ends < 0.005) & (words >= 60) | (ends > 0.6), (ends > 0.02) & (ends < 0.35))
        vote(7, bars > 0.1, (bars == 0) & (words >= 20))
        for i in range(b - a):
            lines = [x for x in d[o[i] : o[i + 1]].tobytes().split(b"\n") if x.strip()]
            if len(lines) >= 3:
                same = 1 - len(set(lines)) / len(lines)
                out[a + i, 2] = 0 if same > 0.3 else 1 if same == 0 else 2
    return out


def code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1])


@dataclass(frozen=True)
class LabelModel:
    """share: of good documents; table[class, labeller, vote]: probability of the vote if it votes, 1 for nothing."""

    share: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        ll = [np.log(p) + np.log(self.table[c][np.arange(v.shape[1]), v]).sum(axis=1) for c, p in ((0, 1 - self.share), (1, self.share))]
        return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller where it votes."""
        right = (1 - self.share) * self.table[0, :, 0] + self.share * self.table[1, :, 1]
        return right / (right + (1 - self.share) * self.table[0, :, 1] + self.share * self.table[1, :, 0])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, from the share of good votes on."""
    k = patterns.shape[1] if patterns.size else len(LABELLERS)
    if not counts.sum():
        return LabelModel(0.5, np.ones((2, k, 3)) * [0.5, 0.5, 1])
    # one bad vote weighs as much as several good ones at first: labellers say bad where they see a fault
    bad, good = (patterns == 0).sum(axis=1), (patterns == 1).sum(axis=1)
    q = np.clip((good + 0.5) / (good + 4 * bad + 1), 0.02, 0.98)
    model = LabelModel(0.5, np.ones((2, k, 3)) * [0.5, 0.5, 1])
    for _ in range(rounds):
        table = np.zeros((2, k, 3))
        for c, w in ((0, counts * (1 - q)), (1, counts * q)):
            for v in range(2):
                table[c, :, v] = (w[:, None] * (patterns == v)).sum(axis=0) + 1
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, 2] = 1
        model = LabelModel(float(np.clip((counts * q).sum() / counts.sum(), 0.01, 0.99)), table)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def hashed(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, values) of each text: words and word shapes, hashed, square roots of counts at length 1."""
    data, off = T.buffers(col)
    for a, b in T.slices(off):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        w, wo = T.word_hashes(d, o)
        s, _ = T.word_hashes(_SHAPE[d], o)
        w, s = (w >> T.U(48)).astype(np.int64), (T.mix(s + T._C[9]) >> T.U(48)).astype(np.int64)
        for i in range(b - a):
            k, n = np.unique(np.concatenate([w[wo[i] : wo[i + 1]], s[wo[i] : wo[i + 1]]]), return_counts=True)
            x = np.sqrt(n)
            yield k, x / max(1e-12, np.sqrt((x * x).sum()))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 60, rate: float = 8.0, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by gradient steps with momentum; classes weigh alike."""
    w, bias = np.zeros(DIMS), 0.0
    if not len(rows):
        return w, bias
    n = np.array([len(k) for k, _ in rows])
    row, dim, val = np.repeat(np.arange(len(rows)), n), np.concatenate([k for k, _ in rows]), np.concatenate([x for _, x in rows])
    good = np.clip(target.mean(), 0.02, 0.98)
    weight = target / (2 * good) + (1 - target) / (2 * (1 - good))
    move, step = np.zeros(DIMS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, val * w[dim], len(rows)) + bias)))
        e = weight * (p - target) / len(rows)
        move = 0.9 * move - rate * (np.bincount(dim, val * e[row], DIMS) + shrink * w)
        step = 0.9 * step - rate * e.sum() / 4
        w, bias = w + move, bias + step
    return w, bias


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, most: int = 6000) -> QualityModel:
    """Votes of all rows of docs (doc_id, text, ...) are counted; about ``most`` of them, by hash, train the scorer."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            total += np.bincount(code(votes(batch.column(0))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    got = rows.select("text").mapInArrow(T.tidied(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    codes, counts = got.column("code").to_numpy(), got.column("n").to_numpy().astype(float)
    labels = fit_labels(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post = labels.posterior(votes(batch.column(1)))
            x = list(hashed(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post), pa.array([k.astype("<u2").tobytes() for k, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())], ["h", "target", "dims", "vals"])

    share = min(1.0, most / max(1.0, counts.sum()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = rows.withColumn("h", h).filter(F.col("h") < int(share * (1 << 30))).select("h", "text").mapInArrow(T.tidied(sample), "h long, target double, dims binary, vals binary").orderBy("h", "dims").toArrow()
    x = [(np.frombuffer(k, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for k, v in zip(some.column("dims").to_pylist(), some.column("vals").to_pylist(), strict=True)]
    weights, bias = fit_scorer(x, some.column("target").to_numpy())
    return QualityModel(labels, weights.astype(np.float32), float(bias))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.35) -> DataFrame:
    """doc_id, votes, posterior, score, kept for each row of docs (doc_id, text, ...).

    votes has a letter for each of LABELLERS: b, g or - for nothing. posterior is the label model's probability
    of good, score the linear scorer's; kept where score is at least the threshold. Whole texts are read; a null
    text counts as empty, which the length labeller calls bad, and is scored by the bias alone. Rows that repeat
    an id are scored each by itself; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array(["b", "g", "-"])
        for batch in batches:
            v = votes(batch.column(1))
            z = np.array([model.bias + float((model.weights[k] * x).sum()) for k, x in hashed(batch.column(1))])
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(r) for r in letters[v]], pa.string()), pa.array(model.labels.posterior(v), pa.float64()), pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_())], ["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.tidied(run), "doc_id long, votes string, posterior double, score double, kept boolean")
