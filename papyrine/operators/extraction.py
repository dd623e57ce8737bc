"""Extraction: documents to metadata, text, parts and an audit trail. A document that can't be read carries an error."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import archives
from ..functions import content as C
from ..functions.compound import doc_text
from ..functions.detect import ORIGIN_ENGINE, _map, is_utf8
from ..functions.markup import markup_text
from ..functions.pdf import pdf_document
from ..providers import Classifier, OcrModels
from ..schema import ERROR, METADATA, PARTS, STEPS, error, null
from .detection import described, metadata_of
from .ocr import decoded, page_of

PDF = "application/pdf"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
# MIME types by the way they are read.
OFFICE = ("application/msword", PPTX, DOCX)
MARKUP = ("application/rss+xml", "application/xhtml+xml", "application/xml", "text/html", "text/xml")
REJECTED = ("application/zip", "application/vnd.oasis.opendocument.text")
IMAGES = ("image/heic", "image/heif", "image/jpeg", "image/png", "image/webp")
EXTENSIONS = {PDF: "pdf", "application/msword": "doc", PPTX: "pptx", DOCX: "docx", "application/epub+zip": "epub"}
ENGINES = {"pdf": "pdf", "office": "office", "epub": "epub", "markup": "direct", "plain": "direct", "image": "ocr"}


@dataclass(frozen=True)
class ExtractionConfig:
    """What an extraction returns; models for types and images are optional."""

    metadata: bool = True
    content: bool = False
    parts: bool = False
    classifier: Classifier | None = None
    ocr: OcrModels | None = None

    @classmethod
    def from_flags(cls, metadata: bool = False, content: bool = False, parts: bool = False, **rest) -> ExtractionConfig:  # noqa: ANN003
        """No flag at all means all three."""
        every = not (metadata or content or parts)
        return cls(metadata or every, content or every, parts or every, **rest)


def is_markup(mime: Column) -> Column:
    """Listed types and all that end in +xml; Markdown isn't markup."""
    return mime.isin(*MARKUP) | mime.endswith("+xml")


def mime_extension(mime: Column) -> Column:
    return F.try_element_at(_map(EXTENSIONS), mime)


def route(mime: Column, is_text: Column) -> Column:
    """How a document is read: pdf, office, epub, markup, image, plain, or unsupported; the first that fits."""
    return (
        F.when(mime == PDF, "pdf")
        .when(mime.isin(*OFFICE), "office")
        .when(mime == "application/epub+zip", "epub")
        .when(is_markup(mime), "markup")
        .when(mime == "text/markdown", "plain")
        .when(mime.isin(*REJECTED), "unsupported")
        .when(mime.isin(*IMAGES), "image")
        .when(is_text, "plain")
        .otherwise("unsupported")
    )


READ = f"struct<text:string,parts:{PARTS},pages:bigint,fault:string,ms:bigint>"


def _parts(blocks: list[dict]) -> list[dict]:
    """Parts of recognised blocks with a text other than white space, numbered from 0."""
    some = [b for b in blocks if b["text"].strip()]
    return [{"index": k, "kind": "text", "text": b["text"], "provenance": {"confidence": b["confidence"], "page": None, "bbox": b["bbox"]}} for k, b in enumerate(some)]


def _reader(models: OcrModels | None):  # noqa: ANN202
    """A UDF that reads archives and images: (way, extension, content) to READ; nulls for null contents."""

    def one(way: str, kind: str, x: bytes) -> tuple:
        if way == "image":
            if models is None:
                raise ValueError("no text recognition models are given")
            blocks = page_of(decoded(x), models)["blocks"]
            parts = _parts(blocks)
            return "\n\n".join(p["text"] for p in parts) or None, parts, None
        if kind == "pdf":
            pages, found = pdf_document(x)
            parts = [{"index": i, "kind": e["kind"], "text": e["text"], "provenance": {"confidence": None, "page": e["page"], "bbox": e["bbox"]}} for i, e in enumerate(found)]
            return "\n".join(pages), parts or None, len(pages)
        readers = {"doc": doc_text, "docx": archives.docx_text, "pptx": archives.pptx_text, "epub": archives.epub_text}
        if kind not in readers:
            raise ValueError(f"no reader for {kind} is built in")
        return readers[kind](x), None, None

    def run(way: pd.Series, kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for w, k, x in zip(way, kind, content, strict=True):
            began, got, fault = time.perf_counter(), (None, None, None), None
            if x is not None:
                try:
                    got = one(w, k, x)
                except Exception as e:  # noqa: BLE001 - one damaged document must not fail the job
                    fault = str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"
            rows.append((*got, fault, int((time.perf_counter() - began) * 1000)))
        return pd.DataFrame(rows, columns=["text", "parts", "pages", "fault", "ms"]).astype({"pages": "Int64"})

    return F.pandas_udf(run, READ)


def extract(files: DataFrame, config: ExtractionConfig | None = None) -> DataFrame:
    """files (content, path where known, ...) with metadata, pipeline, text, parts, error; content is dropped.

    metadata, text and parts are null where the configuration leaves them out; without any of the three nothing is
    computed and the pipeline is empty. Empty content is an error even then. Text stays in the JVM unless it needs
    the tokenizer; archives and images are sent to Python, other rows as nulls.
    """
    config = config or ExtractionConfig()
    rest = [c for c in files.columns if c not in ("content", "metadata", "pipeline", "text", "parts", "error")]
    nothing = F.array().cast(STEPS)
    problem = F.when(F.col("content").isNull(), error("Io", None, "content can't be read")).when(F.length("content") == 0, error("NoContents", None, "document has no contents"))
    if not (config.metadata or config.content or config.parts):
        return files.select(*rest, null(METADATA).alias("metadata"), nothing.alias("pipeline"), null("string").alias("text"), null(PARTS).alias("parts"), problem.alias("error"))

    rows = described(files, config.classifier)
    types = F.create_map(F.lit("types"), F.lit(1).cast("bigint"))
    engine_of = F.coalesce(F.try_element_at(_map(ORIGIN_ENGINE), F.col("origin")), F.lit("rule"))
    detection = F.struct(F.lit("detection").alias("step"), engine_of.alias("engine"), F.lit(0).cast("bigint").alias("duration_ms"), types.alias("outputs"))
    if config.metadata:
        rows = rows.withColumn("metadata", metadata_of(rows))
    shown = F.col("metadata") if config.metadata else null(METADATA)
    if not (config.content or config.parts):
        live = F.coalesce(F.length("content") > 0, F.lit(False))
        return rows.select(*rest, F.when(live, shown).alias("metadata"), F.when(live, F.array(detection)).otherwise(nothing).alias("pipeline"), null("string").alias("text"), null(PARTS).alias("parts"), problem.alias("error"))

    rows = rows.withColumn("_size", F.length("content"))
    rows = rows.withColumn("_route", F.when(F.col("_size") > 0, route(F.col("mime_type"), F.col("is_text"))))
    direct, boxed = F.col("_route").isin("markup", "plain"), F.col("_route").isin("pdf", "office", "epub", "image")
    rows = rows.withColumn("_text", F.when(direct & is_utf8(F.col("content")), F.col("content").cast("string")))
    rows = rows.withColumn("_read", _reader(config.ocr)("_route", mime_extension(F.col("mime_type")), F.when(boxed, F.col("content"))))
    rows = rows.drop("content").withColumn("_marked", markup_text(F.when(F.col("_route") == "markup", F.col("_text"))))
    fault = F.when(direct & F.col("_text").isNull(), "invalid UTF-8").otherwise(F.coalesce("_read.fault", "_marked.fault"))
    rows = rows.withColumn("_fault", fault).withColumn("_text", F.when(F.col("_route") == "markup", F.col("_marked.text")).when(F.col("_route") == "plain", F.col("_text")).otherwise(F.col("_read.text")))

    engine = F.try_element_at(_map(ENGINES), F.col("_route"))
    failed = (
        F.when(F.col("_size").isNull(), error("Io", None, "content can't be read"))
        .when(F.col("_size") == 0, error("NoContents", None, "document has no contents"))
        .when(F.col("_route") == "unsupported", error("UnsupportedFileType", None, F.col("mime_type")))
        .when(F.col("_fault").isNotNull(), F.struct(F.lit("ExtractionEngine").alias("kind"), engine.alias("engine"), F.col("_fault").alias("message")))
    )
    rows = rows.withColumn("error", failed)
    n = F.when(F.col("_read.parts").isNotNull(), F.size("_read.parts")).when(F.col("_route") == "image", 0).otherwise(1)
    ms, way = F.coalesce("_read.ms", F.lit(0).cast("bigint")), F.col("_route")
    counts = (
        F.when(way == "pdf", F.create_map(F.lit("pages"), F.col("_read.pages"), F.lit("parts"), n.cast("bigint")))
        .when(way == "office", F.create_map(F.lit("parts"), n.cast("bigint")))
        .when(way == "image", F.create_map(F.lit("texts"), n.cast("bigint")))
        .otherwise(F.create_map(F.lit("parts"), n.cast("bigint"), F.lit("texts"), F.col("_text").isNotNull().cast("bigint")))
    )
    work = F.struct(F.when(way == "image", "recognition").otherwise("parsing").alias("step"), engine.alias("engine"), ms.alias("duration_ms"), counts.alias("outputs"))
    good = F.col("error").isNull()
    parts = F.coalesce("_read.parts", F.when(way != "image", C.single_part(F.col("_text"))).otherwise(F.array().cast(PARTS)))
    return rows.select(
        *rest, F.when(F.col("_size") > 0, shown).alias("metadata"), F.when(good, F.array(detection, work)).otherwise(nothing).alias("pipeline"),
        (F.when(good, F.col("_text")) if config.content else null("string")).alias("text"), (F.when(good, parts) if config.parts else null(PARTS)).alias("parts"), "error",
    )


def part_rows(results: DataFrame) -> DataFrame:
    """A row for each part (index, kind, text, provenance) beside the other columns of results; parts is dropped.

    Use it in place of explode: the filter that Spark infers for explode goes down to the scan with the whole extraction
    in it, which reads each document twice and makes code too large to compile.
    """
    rest = [c for c in results.columns if c != "parts"]
    rows = results.select(*rest, F.explode_outer("parts").alias("_part"))
    return rows.filter(F.col("_part").isNotNull()).select(*rest, "_part.*")


def summary(results: DataFrame, *more: Column) -> DataFrame:
    """files, succeeded, failed and further aggregates: one row."""
    return results.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), *more)


def as_documents(results: DataFrame, pretty: bool = False) -> DataFrame:
    """json: each result without null fields and without empty pipelines."""
    own = F.struct("metadata", F.when(F.size("pipeline") > 0, F.col("pipeline")).alias("pipeline"), "text", "parts")
    return results.select(C.as_json(own, pretty).alias("json"))
