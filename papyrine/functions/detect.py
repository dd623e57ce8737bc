"""File types from names and bytes: rules, signatures, and what is made of a classifier's scores.

``rule`` is the origin of the extension rules, ``model`` that of a classifier. Without a classifier's weights, types
that no rule decides come from byte signatures, origin ``signature``; they are this library's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that decide the type of valid UTF-8 files.
TEXT_EXTENSIONS = {
    "css": "css", "csv": "csv", "go": "go", "ini": "ini", "java": "java", "js": "javascript", "json": "json",
    "md": "markdown", "nix": "nix", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "sh": "shell",
    "sql": "sql", "toml": "toml", "ts": "typescript", "tsv": "tsv", "txt": "txt", "yaml": "yaml", "yml": "yaml",
}

#: label: (MIME type, group, description, is text, extensions). From public media type registrations, not a model's table.
TYPES = {
    "css": ("text/css", "code", "CSS source", True, ["css"]),
    "csv": ("text/csv", "code", "CSV document", True, ["csv"]),
    "go": ("text/x-golang", "code", "Golang source", True, ["go"]),
    "ini": ("text/plain", "text", "INI configuration file", True, ["ini"]),
    "java": ("text/x-java", "code", "Java source", True, ["java"]),
    "javascript": ("application/javascript", "code", "JavaScript source", True, ["js"]),
    "json": ("application/json", "code", "JSON document", True, ["json"]),
    "markdown": ("text/markdown", "text", "Markdown document", True, ["md"]),
    "nix": ("text/x-nix", "code", "Nix source", True, ["nix"]),
    "php": ("text/x-php", "code", "PHP source", True, ["php"]),
    "python": ("text/x-python", "code", "Python source", True, ["py"]),
    "ruby": ("application/x-ruby", "code", "Ruby source", True, ["rb"]),
    "rust": ("application/x-rust", "code", "Rust source", True, ["rs"]),
    "shell": ("text/x-shellscript", "code", "Shell script", True, ["sh"]),
    "sql": ("application/sql", "code", "SQL source", True, ["sql"]),
    "toml": ("application/toml", "code", "Tom's obvious, minimal language", True, ["toml"]),
    "typescript": ("application/typescript", "code", "TypeScript source", True, ["ts"]),
    "tsv": ("text/tab-separated-values", "code", "TSV document", True, ["tsv"]),
    "txt": ("text/plain", "text", "Generic text document", True, ["txt"]),
    "yaml": ("application/x-yaml", "code", "YAML source", True, ["yaml", "yml"]),
    "html": ("text/html", "code", "HTML document", True, ["html", "htm"]),
    "xhtml": ("application/xhtml+xml", "code", "XHTML document", True, ["xhtml"]),
    "xml": ("text/xml", "code", "XML document", True, ["xml"]),
    "rss": ("application/rss+xml", "code", "RSS feed", True, ["rss"]),
    "rtf": ("text/rtf", "text", "Rich Text Format document", True, ["rtf"]),
    "pdf": ("application/pdf", "document", "PDF document", False, ["pdf"]),
    "doc": ("application/msword", "document", "Microsoft Word CDF document", False, ["doc"]),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", "Microsoft Word 2007+ document", False, ["docx"]),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "document", "Microsoft PowerPoint 2007+ document", False, ["pptx"]),
    "epub": ("application/epub+zip", "document", "EPUB document", False, ["epub"]),
    "odt": ("application/vnd.oasis.opendocument.text", "document", "OpenDocument Text", False, ["odt"]),
    "zip": ("application/zip", "archive", "Zip archive", False, ["zip"]),
    "png": ("image/png", "image", "PNG image", False, ["png"]),
    "jpeg": ("image/jpeg", "image", "JPEG image", False, ["jpg", "jpeg"]),
    "webp": ("image/webp", "image", "WebP image", False, ["webp"]),
    "heic": ("image/heic", "image", "HEIC image", False, ["heic"]),
    "mp4": ("video/mp4", "video", "MP4 media file", False, ["mp4"]),
    "empty": ("inode/x-empty", "inode", "Empty file", False, []),
    "unknown": ("application/octet-stream", "unknown", "Unknown binary data", False, []),
}

# Brands in bytes 4 to 12 of HEIF files.
HEIF_BRANDS = ("ftypheic", "ftypheix", "ftyphevc", "ftyphevx", "ftypheif", "ftypheim", "ftypheis", "ftyphevm", "ftyphevs", "ftypmif1", "ftypmsf1")

ORIGIN_ENGINE = {"rule": "rule", "model": "magika", "signature": "signature"}
WHITE = b"\t\n\x0b\x0c\r "


def _map(pairs: dict) -> Column:
    """A literal map of strings, numbers and booleans."""
    sql = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"double({x!r})" if isinstance(x, float) else str(x)
    return F.expr("map(" + ", ".join(sql(x) for kv in pairs.items() for x in kv) + ")")


def type_info(label: Column) -> Column:
    """struct(label, mime_type, group, description, extensions, is_text) of a label; null for a null label."""
    get = lambda i: F.element_at(_map({k: v[i] for k, v in TYPES.items()}), label)
    some = F.split(F.element_at(_map({k: " ".join(v[4]) for k, v in TYPES.items()}), label), " ")
    some = F.filter(some, lambda e: e != "")
    return F.when(label.isNotNull(), F.struct(label.alias("label"), get(0).alias("mime_type"), get(1).alias("group"), get(2).alias("description"), some.alias("extensions"), get(3).alias("is_text")))


def stem_of(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name != "", F.when(name.rlike(r"^.+\.[^.]*$") & (name != ".."), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name))


def extension_of(path: Column) -> Column:
    """After the last dot; null where there is none but a leading one."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$") & (name != ".."), F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def extension_label(extension: Column, content: Column) -> Column:
    """The label that an extension decides for valid UTF-8, else null. Leading dots and ASCII case don't matter."""
    key = F.translate(F.regexp_replace(extension, r"^\.+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    label = F.try_element_at(_map(TEXT_EXTENSIONS), key)
    return F.when(label.isNotNull() & is_utf8(content), label)


def has_heif_brand(content: Column) -> Column:
    """At least 12 bytes, with a HEIF brand in bytes 4 to 12."""
    brand = F.hex(F.substring(content, 5, 8))
    return (F.length(content) >= 12) & brand.isin([b.encode().hex().upper() for b in HEIF_BRANDS])


def edge_sample(content: Column, block: int) -> Column:
    """The whole of at most two blocks, else the first and the last block."""
    return F.when(F.length(content) <= 2 * block, content).otherwise(F.concat(F.substring(content, 1, block), F.substring(content, -block, block)))


def features(block: int = 4096, begin: int = 1024, end: int = 1024, padding: int = 256):  # noqa: ANN201
    """A UDF, BINARY to ARRAY<INT>: the first bytes, left-aligned, and the last ones, right-aligned; null for no bytes.

    White space at the head of the first block and the tail of the last one is left out.
    """

    def prepare(content: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> np.ndarray | None:
            if not x:
                return None
            out = np.full(begin + end, padding, np.int32)
            head, tail = x[:block].lstrip(WHITE)[:begin], x[-block:].rstrip(WHITE)
            tail = tail[max(0, len(tail) - end) :]
            out[: len(head)] = np.frombuffer(head, np.uint8)
            out[len(out) - len(tail) :] = np.frombuffer(tail, np.uint8)
            return out

        return content.map(one)

    return F.pandas_udf(prepare, "array<int>")


def short_label(content: Column, prepared: Column, least: int = 8, block: int = 4096, padding: int = 256) -> Column:
    """empty for no bytes; txt or unknown for fewer than ``least`` features; else null: the classifier decides."""
    short = F.element_at(prepared, least) == padding
    text = is_utf8(F.substring(content, 1, block))
    return F.when(F.length(content) == 0, "empty").when(short, F.when(text, "txt").otherwise("unknown"))


def argmax(scores: Column) -> Column:
    """struct(index from 0, score, valid): the first highest score; valid if all are finite and within 0 to 1."""
    valid = (F.size(scores) > 0) & F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    top = F.array_max(scores)
    return F.struct(F.when(valid, F.array_position(scores, top) - 1).alias("index"), F.when(valid, top).alias("score"), F.coalesce(valid, F.lit(False)).alias("valid"))


def decided(label: Column, score: Column, threshold: Column, overwrite: dict[str, str] | None = None) -> Column:
    """Under the threshold txt for text types, else unknown; otherwise the label, or what overwrites it. The score stays."""
    text = F.coalesce(F.try_element_at(_map({k: v[3] for k, v in TYPES.items()}), label), F.lit(False))
    own = F.coalesce(F.try_element_at(_map(overwrite), label), label) if overwrite else label
    return F.when(score < threshold, F.when(text, "txt").otherwise("unknown")).otherwise(own)


def heic_override(label: Column, origin: Column, confidence: Column, content: Column) -> Column:
    """struct(label, origin, confidence): an mp4 with a HEIF brand is heic, by rule, for certain."""
    heic = (label == "mp4") & has_heif_brand(content)
    return F.struct(F.when(heic, "heic").otherwise(label).alias("label"), F.when(heic, "rule").otherwise(origin).alias("origin"), F.when(heic, F.lit(1.0)).otherwise(confidence).cast("float").alias("confidence"))


def signature_label(content: Column) -> Column:
    """A label from the first bytes and, for archives, from the names of entries; txt for other valid UTF-8, else unknown."""
    lead = F.hex(F.substring(content, 1, 8))
    text = F.ltrim(F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    inner = F.decode(content, "ISO-8859-1")
    archive = (
        F.when(inner.contains("application/epub+zip"), "epub")
        .when(inner.contains("application/vnd.oasis.opendocument.text"), "odt")
        .when(inner.contains("word/document.xml"), "docx")
        .when(inner.contains("ppt/presentation.xml"), "pptx")
        .otherwise("zip")
    )
    return (
        F.when(F.length(content) == 0, "empty")
        .when(lead.startswith(b"%PDF-".hex().upper()), "pdf")
        .when(lead.startswith("504B0304") | lead.startswith("504B0506"), archive)
        .when(lead.startswith("D0CF11E0A1B11AE1"), "doc")
        .when(lead.startswith("89504E470D0A1A0A"), "png")
        .when(lead.startswith("FFD8FF"), "jpeg")
        .when(lead.startswith(b"RIFF".hex().upper()) & (F.hex(F.substring(content, 9, 4)) == b"WEBP".hex().upper()), "webp")
        .when(has_heif_brand(content), "heic")
        .when(F.hex(F.substring(content, 5, 4)) == b"ftyp".hex().upper(), "mp4")
        .when(~is_utf8(content), "unknown")
        .when(text.startswith("{\\rtf"), "rtf")
        .when(text.contains("http://www.w3.org/1999/xhtml") & text.startswith("<?xml"), "xhtml")
        .when(text.startswith("<!doctype html") | text.rlike(r"^<html[\s>]"), "html")
        .when(text.rlike(r"<rss[\s>]"), "rss")
        .when(text.startswith("<?xml"), "xml")
        .otherwise("txt")
    )
