"""The registered queries, by inventory id, and the SQL that gives the same rows.

Every query runs over its whole tables. Where no SQL can express an operator it has none and is tested on vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import detect as D
from ..functions import geometry as G
from ..functions import rank as R
from ..functions import text as T
from ..functions import vectors as V
from ..functions.blake3 import blake3_hex
from ..functions.markup import markup_text
from ..operators import extraction as X
from ..operators.detection import detect_types, with_metadata
from ..operators.embedding import embed
from ..operators.reranking import rerank_by
from ..providers import ENCODERS, StandInText

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents: page_id, path, content."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


# Fixed values of RE2 patterns: the white space class, and page markup in the order in which it is taken out.
_WS = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PAGE_TEXT = rf"""regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script[\s>].*?</script\s*>', ' ', 'g'), '(?is)<style[\s>].*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'), '<[^>]*>', ' ', 'g'),
  '&apos;', ''''), '&gt;', '>'), '&lt;', '<'), '&nbsp;', ' '), '&quot;', '"'), '&amp;', '&'),
  '{_WS}', ' ', 'g'), '^ | $', '', 'g')"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_SIGMOID = "CAST(1 / (1 + exp(-CAST({x} AS DOUBLE))) AS FLOAT)"


@query(f"SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(text) AS BIGINT) AS succeeded, CAST(0 AS BIGINT) AS failed, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(ascii(text) * (page_id % 101)) AS BIGINT) AS first_characters FROM (SELECT page_id, {_PAGE_TEXT} AS text FROM pages)")
def flagship_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are typed, routed, read, and summed up."""
    out = X.extract(page_files(spark, sf_dir), X.ExtractionConfig(content=True))
    return X.summary(out, F.sum(F.length("text")).alias("characters"), F.sum(F.ascii("text") * (F.col("page_id") % 101)).alias("first_characters"))


@query(f"SELECT page_id, 'html' AS label, 'text/html' AS mime_type, {_PAGE_TEXT} AS text, CAST(1 AS BIGINT) AS n_parts, 'detection,parsing' AS steps FROM pages")
def s2_p1_x14_extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole extraction with metadata, text, parts and audit."""
    out = X.extract(page_files(spark, sf_dir), X.ExtractionConfig.from_flags())
    return out.select("page_id", "metadata.label", "metadata.mime_type", "text", F.size("parts").cast("bigint").alias("n_parts"), F.array_join(F.transform("pipeline", lambda s: s["step"]), ",").alias("steps"))


@query(f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages")
def x2_markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of markup."""
    return table(spark, sf_dir, "pages").select("page_id", markup_text(F.col("html"))["text"].alias("text"))


@query("SELECT conv_id, nullif(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), ''), '') AS text FROM conversations GROUP BY conv_id")
def x11_a2_ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11 A2: parts in order as one text."""
    out = T.concatenated(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")
    return out.withColumn("text", F.nullif("text", F.lit("")))


@query("SELECT doc_id, text, text IS NOT NULL AS has_text FROM documents")
def x1_x12_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict UTF-8, untrimmed, as one part; its canonical text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    text = F.when(D.is_utf8(F.col("b")), F.col("b").cast("string"))
    parts = F.when(text.isNotNull(), C.single_part(text))
    return docs.select("doc_id", C.canonical_text(text, parts).alias("text"), F.coalesce(C.has_text(text, parts), F.lit(False)).alias("has_text"))


# Extensions that decide a type, written out here so that the SQL doesn't follow the library's own table.
_EXTENSIONS = """map {'css': 'css', 'csv': 'csv', 'go': 'go', 'ini': 'ini', 'java': 'java', 'js': 'javascript', 'json': 'json', 'md': 'markdown', 'nix': 'nix', 'php': 'php', 'py': 'python',
'rb': 'ruby', 'rs': 'rust', 'sh': 'shell', 'sql': 'sql', 'toml': 'toml', 'ts': 'typescript', 'tsv': 'tsv', 'txt': 'txt', 'yaml': 'yaml', 'yml': 'yaml'}"""


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages UNION ALL SELECT -p_partkey, lower(p_name) || '.' || substr('csvmdpyymltxtnixHTML', 1 + CAST(p_partkey % 17 AS INT), 2) FROM part),
x AS (SELECT page_id, CASE WHEN name <> '' THEN CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END END AS stem, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '\\.([^.]*)$', 1) END AS extension FROM p)
SELECT page_id AS id, stem, extension, {_EXTENSIONS}[lower(extension)] AS label FROM x""")
def d1_d18_extension_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, extension, and the type that the extension decides."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    end = F.substr(F.lit("csvmdpyymltxtnixHTML"), (1 + F.col("p_partkey") % 17).cast("int"), F.lit(2))
    parts = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("id"), F.concat(F.lower("p_name"), F.lit("."), end).alias("path"), F.col("p_name").cast("binary").alias("content"))
    rows = pages.union(parts)
    return rows.select("id", D.stem_of(F.col("path")).alias("stem"), D.extension_of(F.col("path")).alias("extension"), D.extension_label(D.extension_of(F.col("path")), F.col("content")).alias("label"))


@query("SELECT label, origin, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'html' AS label, 'signature' AS origin FROM pages UNION ALL SELECT CASE WHEN text = '' THEN 'empty' ELSE 'txt' END, CASE WHEN text = '' THEN 'rule' ELSE 'signature' END FROM documents WHERE text IS NOT NULL) GROUP BY label, origin")
def d12_detected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pages and documents where no classifier is given."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").cast("binary").alias("content"))
    out = detect_types(table(spark, sf_dir, "pages").select(F.col("html").cast("binary").alias("content")).union(docs))
    return out.groupBy("label", "origin").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN length(h) <= 1024 THEN h ELSE h[1:512] || h[-512:] END AS sample FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)")
def s7_edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last block of each page, blocks of 256 bytes, in hexadecimal."""
    return table(spark, sf_dir, "pages").select("page_id", F.hex(D.edge_sample(F.col("html").cast("binary"), 256)).alias("sample"))


@query("SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#23') AS heif FROM part")
def d11_heif_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with and without a HEIF brand, one for each part."""
    brand = F.when(F.col("p_brand") == "Brand#11", "ftypheic").when(F.col("p_brand") == "Brand#23", "ftypmif1").otherwise("ftypisom")
    head = F.concat(F.lit("\u0000\u0000\u0000\u0018"), brand, F.lit("\u0000\u0000"))
    rows = table(spark, sf_dir, "part").select("p_partkey", D.heic_override(F.lit("mp4"), F.lit("model"), F.lit(0.5), head.cast("binary"))["label"].alias("label"))
    return rows.select("p_partkey", (F.col("label") == "heic").alias("heif"))


_P = "list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))"


@query(f"""WITH s AS (SELECT vec_id, {_P} AS p FROM embeddings), b AS (SELECT vec_id, list_position(p, list_max(p)) - 1 AS i, list_max(p) AS m FROM s)
SELECT vec_id, CAST(i AS BIGINT) AS index, m AS score, CASE WHEN m < 0.35 THEN CASE WHEN i % 2 = 0 THEN 'txt' ELSE 'unknown' END ELSE CASE WHEN i % 2 = 0 THEN 'html' ELSE 'pdf' END END AS label FROM b""")
def d8_d9_argmax_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to labels; absolute components stand for scores."""
    best = D.argmax(F.transform("e", F.abs))
    rows = _vector(spark, sf_dir).select("vec_id", best.alias("b"))
    label = F.when(F.col("b.index") % 2 == 0, "html").otherwise("pdf")
    return rows.select("vec_id", F.col("b.index").cast("bigint").alias("index"), "b.score", D.decided(label, F.col("b.score"), F.lit(0.35)).alias("label"))


@query()
def d15_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of every page."""
    return page_files(spark, sf_dir).select("page_id", blake3_hex(F.col("content")).alias("hash"))


@query(r"""WITH h AS (SELECT page_id, hex(encode(html)) AS h FROM pages), x AS (SELECT page_id, h, regexp_replace(h[1:8192], '^(09|0A|0B|0C|0D|20)+', '')[1:2048] AS head, regexp_replace(right(h, 8192), '(09|0A|0B|0C|0D|20)+$', '') AS tail FROM h)
SELECT page_id, CASE WHEN h = '' THEN -1 ELSE 2048 END AS n, head, right(tail, 2048) AS tail, CASE WHEN h = '' THEN 'empty' WHEN length(head) < 16 THEN 'txt' END AS ruled FROM x""")
def d4_d5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's inputs for every page, in hexadecimal without the padding, and what short ones are by rule."""
    rows = page_files(spark, sf_dir).select("page_id", "content", D.features()(D.edge_sample(F.col("content"), 4096)).alias("f"))
    text = lambda a: F.array_join(F.transform(F.filter(F.slice("f", a, 1024), lambda x: x != 256), lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return rows.select("page_id", F.size("f").alias("n"), text(1).alias("head"), text(1025).alias("tail"), D.short_label(F.col("content"), F.col("f")).alias("ruled"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages)
SELECT page_id, CASE WHEN name <> '' THEN CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END END AS stem, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_extract(name, '\.([^.]*)$', 1) END AS extension,
'html' AS label, 'text/html' AS mime_type, 'HTML document' AS description, true AS is_text, CAST(1 AS FLOAT) AS confidence, 'signature' AS origin, CAST(64 AS INTEGER) AS hash_length FROM p""")
def d14_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every page; of the hash, which SQL has no function for, the length (d15_blake3 gives it whole)."""
    out = with_metadata(page_files(spark, sf_dir)).select("page_id", "metadata.*")
    return out.withColumn("hash_length", F.length("hash")).drop("hash")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'docx' WHEN 2 THEN NULL WHEN 3 THEN 'csv' ELSE 'zip' END AS label, CASE p_partkey % 5 WHEN 0 THEN 'UnsupportedFileType' WHEN 1 THEN 'ExtractionEngine' WHEN 2 THEN 'NoContents' WHEN 4 THEN 'UnsupportedFileType' END AS kind,
CASE WHEN p_partkey % 5 = 1 THEN 'office' END AS engine, CASE WHEN p_partkey % 5 = 3 THEN 'rule' END AS typed_by, CASE WHEN p_partkey % 5 = 3 THEN 'direct' END AS read_by, CASE WHEN p_partkey % 5 = 3 THEN p_name END AS text FROM part""")
def p3_x18_failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors beside the metadata that are known, and the engines that audits and errors name; one for each part."""
    k = F.col("p_partkey") % 5
    zipped = F.concat(F.unhex(F.lit("504B0304")), F.lit("word/document.xml").cast("binary"))
    content = F.when(k == 0, F.unhex(F.lit("FFFEFDFC80"))).when(k == 1, zipped).when(k == 2, F.lit("").cast("binary")).when(k == 3, F.col("p_name").cast("binary")).otherwise(F.unhex(F.lit("504B030400FF")))
    files = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 3, "names.CSV").otherwise("data").alias("path"), content.alias("content"))
    out = X.extract(files, X.ExtractionConfig(content=True))
    return out.select("p_partkey", "metadata.label", "error.kind", "error.engine", F.get("pipeline", 0)["engine"].alias("typed_by"), F.get("pipeline", 1)["engine"].alias("read_by"), "text")


_ROUTES = """CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN m IN ('application/msword', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') THEN 'office'
WHEN m = 'application/epub+zip' THEN 'epub' WHEN m IN ('application/rss+xml', 'application/xhtml+xml', 'application/xml', 'text/html', 'text/xml') OR m LIKE '%+xml' THEN 'markup' WHEN m = 'text/markdown' THEN 'plain'
WHEN m IN ('application/zip', 'application/vnd.oasis.opendocument.text') THEN 'unsupported' WHEN m IN ('image/heic', 'image/heif', 'image/jpeg', 'image/png', 'image/webp') THEN 'image' WHEN t THEN 'plain' ELSE 'unsupported' END"""
_MIMES = [*X.OFFICE, *X.MARKUP, *X.REJECTED, *X.IMAGES, "application/pdf", "application/epub+zip", "text/markdown", "image/svg+xml", "text/plain", "application/octet-stream"]


@query(f"""WITH x AS (SELECT event_id, [{", ".join(f"'{m}'" for m in _MIMES)}][1 + CAST(event_id % {len(_MIMES)} AS INT)] AS m, event_id % 3 = 0 AS t FROM events)
SELECT event_id, {_ROUTES} AS route, m LIKE '%+xml' OR m IN ('application/rss+xml', 'application/xhtml+xml', 'application/xml', 'text/html', 'text/xml') AS markup, CASE m WHEN 'application/pdf' THEN 'pdf' WHEN 'application/msword' THEN 'doc' WHEN 'application/epub+zip' THEN 'epub'
WHEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' THEN 'pptx' WHEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN 'docx' END AS extension FROM x""")
def p2_p4_p5_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME types to the way they are read, one for each event."""
    mime = F.get(F.array(*[F.lit(m) for m in _MIMES]), (F.col("event_id") % len(_MIMES)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", mime.alias("m"), (F.col("event_id") % 3 == 0).alias("t"))
    return rows.select("event_id", X.route(F.col("m"), F.col("t")).alias("route"), X.is_markup(F.col("m")).alias("markup"), X.mime_extension(F.col("m")).alias("extension"))


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))) AS BIGINT) AS kept, CAST(len(l) AS BIGINT) AS parts FROM p""")
def p7_blank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts; blank ones go, the others are numbered anew."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: C.part(i.cast("bigint"), F.lit("text"), t))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", lines.alias("l"))
    kept = C.without_blank_parts(F.col("l"))
    last = F.when(F.size(kept) > 0, F.element_at(kept, -1)["index"] + 1).otherwise(0)
    return rows.select("doc_id", last.cast("bigint").alias("kept"), F.size("l").cast("bigint").alias("parts"))


@query("SELECT page_id, CAST(1 AS BIGINT) AS types, CAST(1 AS BIGINT) AS parts, CAST(CASE WHEN text IS NULL THEN 0 ELSE 1 END AS BIGINT) AS texts FROM (SELECT page_id, " + _PAGE_TEXT + " AS text FROM pages)")
def x15_a3_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each audit step of a page counts."""
    out = X.extract(page_files(spark, sf_dir), X.ExtractionConfig(content=True))
    get = lambda i, k: F.col("pipeline")[i]["outputs"][k].alias(k)
    return out.select("page_id", get(0, "types"), get(1, "parts"), get(1, "texts"))


def _dealt(rows: DataFrame, key: str, each: int = 5000) -> DataFrame:
    """rows by key to tasks of about ``each`` rows: a small file is read in one task, however long each of its rows then takes.

    The number of tasks is given, as Spark would join small partitions again by their bytes.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def _data_sheets(parts: DataFrame) -> DataFrame:
    """A PDF of two pages for each part: a title and a paragraph; a list and a table."""
    lit = lambda x: F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r"([()\\\\])", r"\\\\$1")
    first = F.concat(F.lit("BT /F 20 Tf 72 700 Td ("), lit("p_name"), F.lit(") Tj /F 10 Tf 0 -40 Td (The part named ) Tj ("), lit("p_name"), F.lit(") Tj 0 -12 Td (is of type ) Tj ("), lit("p_type"), F.lit(") Tj ET"))
    second = F.concat(F.lit("BT /F 10 Tf 72 700 Td (- ) Tj ("), lit("p_brand"), F.lit(") Tj 0 -12 Td (- the second) Tj 0 -40 Td (key) Tj 200 0 Td (size) Tj -200 -12 Td ("), lit("p_partkey"), F.lit(") Tj 200 0 Td ("), lit("p_size"), F.lit(") Tj ET"))
    stream = lambda n, x: F.concat(F.lit(f"{n} 0 obj\n<< /Length "), F.octet_length(x).cast("string"), F.lit(" >>\nstream\n"), x, F.lit("\nendstream\nendobj\n"))
    head = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 5 0 R >>\nendobj\n4 0 obj\n<< /Type /Page /Contents 6 0 R >>\nendobj\n"
    return parts.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), F.concat(F.lit(head), stream(5, first), stream(6, second)).cast("binary").alias("content"))


@query("""SELECT p_partkey, CAST(i - 1 AS BIGINT) AS part, ['heading', 'paragraph', 'list_item', 'list_item', 'table', 'table', 'table', 'table'][i] AS kind, CAST(CASE WHEN i < 3 THEN 1 ELSE 2 END AS BIGINT) AS page,
  [p_name, 'The part named ' || p_name || ' is of type ' || p_type, p_brand, 'the second', 'key', 'size', CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)][i] AS text,
  CAST([20, 22, 22, 22, 22, 22, 22, 22][i] AS BIGINT) AS height FROM part, range(1, 9) r(i)""")
def x8_x9_pdf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of PDF pages with kind, page and box, for a data sheet made of each part."""
    rows = _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey")
    out = X.extract(_data_sheets(rows), X.ExtractionConfig(parts=True)).select("p_partkey", "parts")
    return X.part_rows(out).select("p_partkey", F.col("index").alias("part"), "kind", "provenance.page", "text", F.round("provenance.bbox.height").cast("bigint").alias("height"))


@query("SELECT page_id, CAST(json_extract_string(j, '$.index') AS BIGINT) AS index, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.text') AS text FROM (SELECT page_id, to_json({'index': 0, 'kind': 'text', 'text': url}) AS j FROM pages)")
def s12_s15_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON without null fields, read again."""
    rows = table(spark, sf_dir, "pages").select("page_id", C.as_json(C.part(F.lit(0), F.lit("text"), F.col("url")), pretty=True).alias("j"))
    return rows.select("page_id", F.from_json("j", "index bigint, kind string, text string").alias("p")).select("page_id", "p.*")


@query("SELECT conv_id, turn, 'query: ' || regexp_replace(regexp_replace(text, '^" + _WS + "', ''), '" + _WS + "$', '') AS text FROM conversations")
def e4_prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed texts after a prompt that isn't."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.with_prompt(F.col("text"), F.lit("query: ")).alias("text"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12) AS FLOAT)) AS v FROM embeddings")
def e11_l2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at length 1."""
    return _vector(spark, sf_dir).select("vec_id", V.l2_normalised(F.col("e")).alias("v"))


@query("""WITH t AS (SELECT vec_id, [list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[33:48], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[49:64], lambda x: CAST(x AS DOUBLE))] AS t, [1, 1, vec_id % 2, 0] AS m FROM embeddings)
SELECT vec_id, list_transform(range(1, 17), lambda i: CAST((t[1][i] * m[1] + t[2][i] * m[2] + t[3][i] * m[3]) / greatest(m[1] + m[2] + m[3], 1e-9) AS FLOAT)) AS mean, list_transform(t[1], lambda x: CAST(x AS FLOAT)) AS first FROM t""")
def e9_e10_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four token vectors of 16 components each, pooled both ways."""
    tokens = F.array(*[F.slice("e", 1 + 16 * i, 16) for i in range(4)])
    mask = F.array(F.lit(1), F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))
    return _vector(spark, sf_dir).select("vec_id", V.mean_pooled(tokens, mask).alias("mean"), V.cls_pooled(tokens).cast("array<float>").alias("first"))


@query("WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM embeddings) SELECT vec_id, list_transform(range(1, len(m) + 1), lambda i: CAST(CASE WHEN m[i] <> 0 THEN list_sum(m[1:i]) + 1 ELSE 1 END AS INTEGER)) AS ids FROM m")
def e8_position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions over unmasked tokens; positive components stand for the mask, 1 for the pad id."""
    mask = F.transform("e", lambda x: F.when(x > 0, 1).otherwise(0))
    return _vector(spark, sf_dir).select("vec_id", V.position_ids(mask, 1).cast("array<int>").alias("ids"))


# The encoders' sizes, poolings and token limits, written out for the SQL.
@query("""SELECT * FROM (VALUES ('all-MiniLM-L6-v2', 384, 'mean', 256), ('all-MiniLM-L12-v2', 384, 'mean', 128), ('bge-small-en-v1.5', 384, 'cls', 512), ('bge-base-en-v1.5', 768, 'cls', 512),
('bge-large-en-v1.5', 1024, 'cls', 512), ('all-mpnet-base-v2', 768, 'mean', 384), ('bge-m3', 1024, 'cls', 8192)) t(model, size, pooling, most_tokens)""")
def e3_e7_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known encoders."""
    return spark.createDataFrame([(k, *v) for k, v in ENCODERS.items()], "model string, size int, pooling string, most_tokens int")


@query("""SELECT CAST(q AS INTEGER) AS query, list(CAST(CASE WHEN k > q THEN 16 ELSE 0 END + CASE WHEN abs(k - q) < 8 THEN abs(k - q) ELSE least(15, 8 + trunc(ln(greatest(abs(k - q), 1) / 8.0) / ln(16.0) * 8)) END AS INTEGER) ORDER BY k) AS buckets
FROM range(128) a(q), range(128) b(k) GROUP BY q""")
def e14_relative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the distances within 128 positions."""
    b = V.relative_buckets(128)
    return spark.createDataFrame([(i, [int(x) for x in b[i]]) for i in range(128)], "query int, buckets array<int>")


@query()
def e2_embedded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn to a vector; a stand-in for a model, which computes word counts."""
    return embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), StandInText()).drop("text")


_SCORES = "WITH s AS (SELECT vec_id, label, " + _DOT.format(a="embedding", b="list_transform(range(64), lambda i: (i % 7) - 3)") + " AS s FROM embeddings)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", V.dot(F.col("embedding"), F.array(*[F.lit(i % 7 - 3) for i in range(64)])).alias("s"))


@query(_SCORES + f" SELECT vec_id, {_SIGMOID.format(x='s')} AS score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def r5_r6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoids of scores, the ten highest, ties by index."""
    return R.top_k(_scored(spark, sf_dir).select("vec_id", R.sigmoid(F.col("s")).alias("score")), "score", "vec_id", 10)


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s) SELECT vec_id, label, s, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def r5_top_k_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 for each query: the three highest of each label."""
    return R.top_k_by(_scored(spark, sf_dir), "label", "s", "vec_id", 3)


@query()
def r4_reranked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns ranked against its first one; the scorer is a stand-in for a model."""
    t = table(spark, sf_dir, "conversations")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    pairs = t.join(first, "conv_id").select("conv_id", "turn", "query", F.col("text").alias("document"))
    return rerank_by(pairs, StandInText(), "conv_id", 3, index="turn", normalize=True).select("conv_id", "turn", "score", "rank")


_BOX = "[CAST(embedding[{0}] AS DOUBLE), CAST(embedding[{1}] AS DOUBLE), CAST(embedding[{0}] AS DOUBLE) + abs(CAST(embedding[{2}] AS DOUBLE)), CAST(embedding[{1}] AS DOUBLE) + abs(CAST(embedding[{3}] AS DOUBLE))]"


def _boxes(c: str = "e") -> list:
    at = lambda i: F.element_at(c, i)
    return [[at(a), at(b), at(a) + F.abs(at(w)), at(b) + F.abs(at(h))] for a, b, w, h in ((1, 2, 3, 4), (5, 6, 7, 8))]


@query(f"""WITH b AS (SELECT vec_id, {_BOX.format(1, 2, 3, 4)} AS a, {_BOX.format(5, 6, 7, 8)} AS b FROM embeddings),
i AS (SELECT vec_id, a, b, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS c, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) AS s FROM b)
SELECT vec_id, round(CASE WHEN s - c <= 0 THEN 0 ELSE c / (s - c) END, 9) AS iou FROM i""")
def l10_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two boxes made of a vector's components."""
    a, b = _boxes()
    return _vector(spark, sf_dir).select("vec_id", F.round(G.iou(a, b), 9).alias("iou"))


@query(f"""WITH b AS (SELECT vec_id, {_BOX.format(1, 2, 3, 4)} AS a, abs(CAST(embedding[9] AS DOUBLE)) AS n FROM embeddings), d AS (SELECT vec_id, a, n * 1.4 / (2 * ((a[3] - a[1]) + (a[4] - a[2]))) AS d FROM b)
SELECT vec_id, round(a[1] - d, 9) AS x0, round(a[2] - d, 9) AS y0, round(a[3] + d, 9) AS x1, round(a[4] + d, 9) AS y1 FROM d""")
def o11_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by their area and perimeter."""
    out = G.expanded(*_boxes()[0], 1.4, F.abs(F.element_at("e", 9)))
    return _vector(spark, sf_dir).select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(out, ("x0", "y0", "x1", "y1"), strict=True)])


@query("""WITH s AS (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, CAST(p_partkey % 5003 + 1 AS DOUBLE) AS h FROM part),
a AS (SELECT *, greatest(1, 736 / least(w, h)) AS r FROM s), b AS (SELECT p_partkey, floor(w * r) AS w, floor(h * r) AS h FROM a), c AS (SELECT *, CASE WHEN greatest(w, h) > 4000 THEN 4000 / greatest(w, h) ELSE 1 END AS r FROM b),
d AS (SELECT p_partkey, floor(w * r) / 32 AS w, floor(h * r) / 32 AS h FROM c)
SELECT p_partkey, CAST(greatest(32, round_even(w, 0) * 32) AS INTEGER) AS width, CAST(greatest(32, round_even(h, 0) * 32) AS INTEGER) AS height FROM d""")
def o3_detector_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: input sizes of the text detector, one image size for each part."""
    size = G.detector_size(F.col("p_size") * 40, F.col("p_partkey") % 5003 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 20) % 4 AS INTEGER)) AS i, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS s FROM embeddings),
n AS (SELECT vec_id, i, s, list_filter(range(1, len(i) + 1), lambda k: i[k] <> 0 AND (k = 1 OR i[k] <> i[k - 1])) AS k FROM x)
SELECT vec_id, coalesce(array_to_string(list_transform(k, lambda j: ['a', 'b', 'c'][i[j]]), ''), '') AS text, round(CAST(CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda j: s[j])) / len(k) ELSE 0 END AS FLOAT)::DOUBLE, 6) AS confidence FROM n""")
def o17_a4_ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding; classes and scores come from components."""
    classes = F.transform("e", lambda x: (F.floor(F.abs(x) * 20) % 4).cast("int"))
    out = G.ctc_text(classes, F.transform("e", F.abs), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = _vector(spark, sf_dir).select("vec_id", out.alias("o"))
    return rows.select("vec_id", "o.text", F.round(F.col("o.confidence").cast("double"), 6).alias("confidence"))


@query("""WITH s AS (SELECT vec_id, list_transform(range(16), lambda p: greatest(embedding[4 * p + 1], embedding[4 * p + 2], embedding[4 * p + 3], embedding[4 * p + 4])) AS m FROM embeddings), u AS (SELECT vec_id, unnest(range(16)) AS p, unnest(m) AS m FROM s)
SELECT vec_id, list(CAST(p AS INTEGER) ORDER BY m DESC, p)[1:5] AS top FROM u GROUP BY vec_id""")
def l5_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five proposals with the highest class scores, of sixteen with four classes."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice(F.col("e"), 4 * p + 1, 4))
    return _vector(spark, sf_dir).select("vec_id", G.proposals(scores, 5).cast("array<int>").alias("top"))


# Names of the layout classes, written out for the SQL.
_LABELS = """['abstract', 'algorithm', 'aside_text', 'chart', 'content', 'formula', 'doc_title', 'figure_title', 'footer', 'footer', 'footnote', 'formula_number', 'header', 'header', 'image',
'formula', 'number', 'paragraph_title', 'reference', 'reference_content', 'seal', 'table', 'text', 'text', 'vision_footnote']"""


@query(f"SELECT event_id, coalesce({_LABELS}[1 + CAST(event_id % 27 AS INT)], CAST(event_id % 27 AS VARCHAR)) AS label FROM events")
def l13_layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class ids to names, two of them beyond the list; one for each event."""
    return table(spark, sf_dir, "events").select("event_id", G.layout_label((F.col("event_id") % 27).cast("int")).alias("label"))


@query("SELECT vec_id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(CAST(embedding[3] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) AS FLOAT) AS width, CAST(CAST(embedding[4] AS DOUBLE) - CAST(embedding[2] AS DOUBLE) AS FLOAT) AS height FROM embeddings")
def l15_extent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to corner and size; components stand for edges."""
    at = lambda i: F.element_at("e", i)
    return _vector(spark, sf_dir).select("vec_id", G.extent_box(at(1), at(2), at(3), at(4)).alias("b")).select("vec_id", "b.*")


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN vec_id END AS page, CASE WHEN vec_id % 3 = 0 THEN CAST(abs(embedding[5]) AS FLOAT) END AS confidence, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y,
CAST(embedding[3] AS FLOAT) AS width, CAST(embedding[4] AS FLOAT) AS height FROM embeddings""")
def x17_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a part comes from: its box, and its page and confidence where they are known."""
    at = lambda i: F.element_at("e", i)
    own = C.provenance(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")), C.box(at(1), at(2), at(3), at(4)), F.when(F.col("vec_id") % 3 == 0, F.abs(at(5))))
    rows = _vector(spark, sf_dir).select("vec_id", C.part(F.lit(0), F.lit("text"), F.lit("x"), own)["provenance"].alias("p"))
    return rows.select("vec_id", "p.page", "p.confidence", "p.bbox.*")


@query(f"""WITH c AS (SELECT vec_id, embedding AS e, unnest(range(50)) AS k FROM embeddings),
s AS (SELECT vec_id, k // 25 AS p, k % 25 AS c, {_SIGMOID.format(x="e[k + 1]")} AS score, e FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, p, c) AS n FROM s WHERE score >= 0.5)
SELECT vec_id, CAST(count(*) AS BIGINT) AS found, max(score) AS best, string_agg({_LABELS}[c + 1], ',' ORDER BY CASE p WHEN 0 THEN 1 ELSE 0 END, {_LABELS}[c + 1], score) AS labels FROM t WHERE n <= 10 GROUP BY vec_id""")
def l7_l8_l12_layout_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of two proposals with 25 classes each, at most ten, in reading order."""
    logits = F.array(F.slice("e", 1, 25), F.slice("e", 26, 25))
    boxes = F.array(*[F.array(*[F.lit(x) for x in b]) for b in ((0.5, 0.5, 0.2, 0.2), (0.5, 0.2, 0.2, 0.2))])
    found = G.in_reading_order(G.layout_candidates(logits, boxes, F.array(F.lit(1), F.lit(0)), F.lit(100), F.lit(200), 0.5, 10))
    rows = _vector(spark, sf_dir).select("vec_id", found.alias("d")).filter(F.size("d") > 0)
    return rows.select("vec_id", F.size("d").cast("bigint").alias("found"), F.array_max(F.transform("d", lambda x: x["score"])).alias("best"), F.array_join(F.transform("d", lambda x: x["label"]), ",").alias("labels"))


@query("""WITH p AS (SELECT p_partkey, regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g') AS a, regexp_replace(trim(lower(p_type)), '\\s+', ' ', 'g') AS b FROM part)
SELECT p_partkey, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity FROM p""")
def a7_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of each part's name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(count_if(text IS NOT NULL AND text <> '') AS BIGINT) AS succeeded, CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS failed FROM documents")
def a1_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, read and summed up; empty ones fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return X.summary(X.extract(docs, X.ExtractionConfig(content=True, metadata=False)))
