"""Operators that SQL can't express, against plain Python on whole tables."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from papyrine.llm import language_id, quality, secrets
from papyrine.llm import queries as Q

ROOT = "/root/testdata/sf0.01"


def test_language_by_exact_sets(spark):
    """The same decision from exact sets of n-grams instead of the bit-sliced filter."""

    def grams(text, n=5):
        b = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower().encode())
        return [b[i : i + n] for i in range(len(b) - n + 1) if b[i] & 0xC0 != 0x80]

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = docs.collect()
    counts: dict = {}
    sizes = Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            sizes[r.lang] += 1
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) for k in langs}
    top: dict = {}
    for k in langs:
        for g, n in counts[k].items():
            top[g] = max(top.get(g, 0.0), n / total[k])
    known = {k: {g for g, n in counts[k].items() if n >= 2 and n / total[k] >= max(2e-6, 0.2 * top[g])} for k in langs}
    cover = {k: sum(counts[k][g] for g in known[k]) / total[k] for k in langs}
    got = {r.doc_id: r for r in language_id.fit_and_identify(docs).collect()}
    assert len(got) == len(rows)
    near = compared = 0
    for r in rows:
        if not any(unicodedata.category(c).startswith("L") for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        c = {k: sum(g in known[k] for g in grams(r.text)) / cover[k] for k in langs}
        every = sum(c.values())
        if not every:
            continue
        order = sorted(langs, key=lambda k: (-c[k], k))
        slack = 0.02 * every + 2.5 * max(Counter(grams(r.text)).values())  # the filter's false positives, at least two n-grams with their repeats
        if c[order[0]] - c[order[1]] <= slack:
            near += 1
            continue
        compared += 1
        assert got[r.doc_id].lang_pred == order[0]
        assert abs(got[r.doc_id].score - c[order[0]] / every) < slack / every
    assert near <= 0.03 * len(rows) and compared > 900


def plain_votes(text):
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, size = len(words), max(len(b), 1)
    some = max(n, 1)
    upper = sum(65 <= c <= 90 for c in b)
    letters = upper + sum(97 <= c <= 122 or c >= 0xC0 for c in b)
    marks = sum(32 < c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:'\"-()!?" for c in b) / size
    caps, mean = upper / max(letters, 1), sum(map(len, words)) / some
    short = sum(len(w) <= 3 for w in words) / some
    ends, bars = sum(c in b".!?" for c in b) / some, sum(c in b"|\t" for c in b) / some
    lines = [x for x in b.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / len(lines) if len(lines) >= 3 else None
    rules = [
        (marks > 0.04, marks < 0.004),
        (caps > 0.4, caps < 0.15 and letters > 20),
        (same is not None and same > 0.3, same == 0),
        (n < 5, 40 <= n <= 50_000),
        (short < 0.06 and n >= 10, 0.15 < short < 0.7 and n >= 10),
        (mean > 11 or mean < 2.5, 3.5 < mean < 8),
        (ends < 0.005 and n >= 60 or ends > 0.6, 0.02 < ends < 0.35),
        (bars > 0.1, bars == 0 and n >= 20),
    ]
    return [0 if bad else 1 if good else 2 for bad, good in rules]


def test_quality_by_single_rows(spark):
    """Votes of each text by hand; expectation-maximisation over rows instead of counted patterns; scores text by text."""
    odd = [(-1, None), (-2, ""), (-3, "a\tb|c\n" * 40), (-4, "HELLO WORLD! " * 30), (-5, "né|ü\x7f\n\n\n x"), (-6, "word " * 30_000)]
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.collect()
    model = quality.fit(docs)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    v = np.array([plain_votes(r.text) for r in rows])
    assert [got[r.doc_id].votes for r in rows] == ["".join("bg-"[x] for x in own) for own in v.tolist()]

    good, bad = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
    q = np.clip((good + 0.5) / (good + 4 * bad + 1), 0.02, 0.98)
    for _ in range(200):
        share = float(np.clip(q.mean(), 0.01, 0.99))
        new = []
        weight = {(c, j, x): 1 + float((q if c else 1 - q)[v[:, j] == x].sum()) for c in (0, 1) for j in range(v.shape[1]) for x in (0, 1)}
        for own in v.tolist():
            odds = share / (1 - share)
            for j, x in enumerate(own):
                if x < 2:
                    p = [weight[c, j, x] / (weight[c, j, 0] + weight[c, j, 1]) for c in (0, 1)]
                    odds *= p[1] / p[0]
            new.append(odds / (1 + odds))
        moved, q = np.abs(np.array(new) - q).max(), np.array(new)
        if moved < 1e-9:
            break
    assert np.allclose([got[r.doc_id].posterior for r in rows], q, atol=1e-6)

    for r in rows[::97] + rows[-len(odd) :]:
        ((k, x),) = quality.hashed(pa.array([r.text or ""]))
        z = model.bias + sum(float(model.weights[i]) * y for i, y in zip(k, x, strict=True))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-5
        assert got[r.doc_id].kept == (got[r.doc_id].score >= 0.35)


def plain_features(c, before, path):
    n, hit = len(c), lambda p, s: regex.search(p, s, regex.ASCII) is not None
    share = lambda p: len(regex.findall(p, c)) * 15 / n
    rest = c.lower()
    rest = regex.sub("|".join(sorted(secrets.DICTIONARY, key=lambda w: (-len(w), w))), "", rest)
    switches = sum((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) or (a.islower() and b.isupper()) or (a.isupper() and b.islower()) for a, b in zip(c, c[1:]) if (a + b).isascii())  # noqa: B905
    values = [
        n / 4, share("[0-9]"), share("[A-Z]"), share("[a-z]"), switches * 15 / n, len(set(c)) / 3,
        (set(c) <= set("0123456789abcdef") or set(c) <= set("0123456789ABCDEF")) and hit("(?i)[a-f]", c), share("[aeiouAEIOU]") * 2, (n - len(rest)) * 15 / n,
        hit(secrets.SECRET_WORDS, before), hit(secrets.OTHER_WORDS, before), hit("[=:]\\s*[\"']?$", before), before[-1:] in ('"', "'") and before != "",
        hit(secrets.PATH_WORDS, path), sum(x in "_/-" for x in c) * 2, hit(r"(?i)xxx|example|dummy|placeholder|changeme|1234|0000|(.)\1\1\1", c),
    ]
    return [min(15, int(np.floor(float(x)))) for x in values]


def test_secrets_by_brute_force(spark):
    """Candidates, places, features and the walk through the trees, on labelled findings and whole documents."""
    found = secrets.labelled_findings(spark).select("doc_id", "text", F.col("path").alias("source"))
    docs = found.union(spark.read.parquet(f"{ROOT}/documents.parquet").select(F.col("doc_id") + 100_000, "text", "source"))
    find = regex.compile(secrets.CANDIDATE, regex.ASCII)
    forest = secrets.train(secrets.labelled_findings(spark))
    want = {}
    for r in docs.collect():
        own = list(find.finditer(r.text or ""))
        for i, m in enumerate(own):
            before = r.text[own[i - 1].end() if i else 0 : m.start()][-48:]
            f = plain_features(m[0], before, r.source or "")
            score = 0.0
            for splits, leaves in forest:
                node = 1
                while node in splits:
                    j, b = splits[node]
                    node = 2 * node + (f[j] > b)
                score += leaves.get(node, 0.5)
            want[r.doc_id, i] = (m.start(), len(m[0]), score / len(forest))
    got = {(r.doc_id, r.ordinal): r for r in secrets.scan(docs, forest).collect()}
    assert len(want) > 2000
    assert {k: (r.start, r.length) for k, r in got.items()} == {k: x[:2] for k, x in want.items()}
    assert all(abs(got[k].score - x[2]) < 2e-6 for k, x in want.items())


def test_pipeline_ends_in_the_library_s_ids(spark):
    """The last stage on rows that a mix may repeat: ids of the library, one after the other by doc_id."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.filter("doc_id % 3 = 0")).union(docs.filter("doc_id % 3 = 0").limit(5))
    got = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
