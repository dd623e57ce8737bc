"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language_id, mixing, near_dedup, pii, quality, secrets, token_blocks, topk

END_ID = 2
#: For the synthetic tables; real ones need a secret in spark.papyrine.surrogate.key.
SURROGATE_KEY = "synthetic tables only"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.fit_and_identify(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("first_position", 9).alias("first_position"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_documents(table(spark, sf_dir, "conversations"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.digests(token_blocks.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(table(spark, sf_dir, "documents"), spark.conf.get("spark.papyrine.surrogate.key", SURROGATE_KEY)).select("doc_id", "n_entities", "text")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_language_id, op3_mixing, op4_chat_formatting, op5_token_output, op6_quality, op7_near_dedup, op8_topk, op9_pii, op10_secrets)
}

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][(rnk % 3) + 1] AS BIGINT) AS w FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(source_size * 2 AS DOUBLE) / w AS ratio FROM s2),
s4 AS (SELECT *, (budget - CAST(coalesce(sum(source_size * 2) OVER e, 0) AS DOUBLE)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS DOUBLE) AS here
  FROM s3 WINDOW e AS (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, (SELECT x.here FROM s4 x WHERE x.ratio > x.here ORDER BY x.ratio, x.rnk LIMIT 1) AS lvl FROM s4),
s6 AS (SELECT *, CASE WHEN lvl IS NULL OR ratio <= lvl THEN cap ELSE lvl * w END AS target FROM s5),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s6),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
m AS (SELECT p.doc_id, p.size, s.source_size, s.target, s.rnk, p.before,
  CAST(s.whole + CASE WHEN p.before + p.size / 2.0::DOUBLE < s.target - s.whole * s.source_size THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, least((before + size / 2.0::DOUBLE) / greatest(target, 1.0::DOUBLE), 1.0::DOUBLE) AS u FROM m)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE rnk % 3 WHEN 0 THEN least((sqrt(greatest(0, 2.25::DOUBLE - 2 * u)) - 1.5::DOUBLE) / -1.0::DOUBLE, 1)
    WHEN 1 THEN least(u, 1) ELSE least(sqrt(0.25::DOUBLE + 2 * u) - 0.5::DOUBLE, 1) END, 9) END AS first_position
FROM t
"""

_CHAT = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l, len(l) AS n FROM c GROUP BY l),
m AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND b.l[1:a.n] = a.l)),
x AS (SELECT conv_id, n, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM m)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns,
  string_agg('<|im_start|>' || replace(coalesce(e.r, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(e.t, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM x GROUP BY conv_id, n
"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id, s.doc_id <= coalesce(c.least, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT x, min(y) AS least FROM r GROUP BY x) c ON c.x = s.doc_id
"""

_TOPK = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": _MIXING, "op4_chat_formatting": _CHAT, "op7_near_dedup": _NEAR, "op8_topk": _TOPK}
