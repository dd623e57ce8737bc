"""Operators on files made here, and on stand-ins for models."""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions import imaging
from papyrine.operators import detection, embedding, extraction, layout, ocr, reranking
from papyrine.providers import ENCODERS, Classifier, StandInClassifier, StandInLayout, StandInOcr, StandInText, asset, padded, pooled
from papyrine.sources import files
from papyrine.streaming.index import index_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = zipped(**{"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>again</w:t></w:r></w:p></w:body></w:document>'})
PPTX = zipped(**{
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
    "ppt/slides/slide1.xml": f'<s xmlns:a="{A}"><a:p><a:t>one</a:t></a:p></s>', "ppt/slides/slide2.xml": f'<s xmlns:a="{A}"><a:p><a:t>two</a:t></a:p></s>',
})
EPUB = zipped(**{
    "mimetype": "application/epub+zip", "META-INF/container.xml": '<c xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>',
    "o/p.opf": '<p xmlns="o"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></p>',
    "o/a.xhtml": "<p>second</p>", "o/b.xhtml": "<p>first &amp; more</p>",
})
_page = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj 0 -14 Td [(spl) -20 (it)] TJ ET")
PDF = b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + _page + b"\nendstream\nendobj\n"


def image() -> bytes:
    x = np.full((736, 736, 3), 255, np.uint8)
    x[100:140, 100:400] = 0
    x[300:340, 50:650] = 0
    return imaging.encode_png(x)


FILES = {
    "a.md": b"# raw *text*\n", "b.html": b"<!doctype html><p>Hi &amp; bye</p>", "c.docx": DOCX, "d.pptx": PPTX, "e.epub": EPUB, "f.pdf": PDF, "g.zip": zipped(x="y"), "h.odt": zipped(mimetype="application/vnd.oasis.opendocument.text"),
    "i.bin": b"\xff\xfe\xfd\xfc", "j.txt": b"", "k.csv": b"a,b\n1,2\n", "l.xml": b"<?xml version='1.0'?><a>x</a>", "m.rtf": b"{\\rtf1 x}", "n.png": image(), "o.html": b"<html><a<", "p.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1xx", "q.docx": DOCX[:60],
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()] + [("r.txt", None)], "path string, content binary")


def test_extract(corpus):
    cfg = extraction.ExtractionConfig.from_flags(ocr=StandInOcr())
    got = {r.path: r for r in extraction.extract(corpus, cfg).collect()}
    assert got["a.md"].text == "# raw *text*\n"
    assert got["a.md"].metadata.asDict() | {"hash": ""} == {"stem": "a", "extension": "md", "label": "markdown", "mime_type": "text/markdown", "description": "Markdown document", "is_text": True, "confidence": 1.0, "origin": "rule", "hash": ""}
    assert got["b.html"].text == "Hi & bye"
    assert [s.step for s in got["b.html"].pipeline] == ["detection", "parsing"]
    assert got["b.html"].pipeline[1].outputs == {"parts": 1, "texts": 1}
    assert got["c.docx"].text == "Hello\tthere\nagain"
    assert got["d.pptx"].text == "two\n\none"
    assert got["e.epub"].text == "first & more\nsecond"
    assert got["f.pdf"].text == "Hello (PDF)\nsplit"
    assert got["f.pdf"].parts[0].provenance.page == 1
    assert got["f.pdf"].pipeline[1].outputs == {"pages": 1, "parts": 1}
    assert got["k.csv"].text == "a,b\n1,2\n"
    assert got["l.xml"].text == "x"
    assert got["m.rtf"].text == "{\\rtf1 x}"
    errors = {k: r.error.kind for k, r in got.items() if r.error}
    assert errors == {"g.zip": "UnsupportedFileType", "h.odt": "UnsupportedFileType", "i.bin": "UnsupportedFileType", "j.txt": "NoContents", "o.html": "ExtractionEngine", "p.doc": "ExtractionEngine", "q.docx": "ExtractionEngine", "r.txt": "Io"}
    assert got["g.zip"].metadata.label == "zip"
    assert got["g.zip"].text is None
    assert [p.text for p in got["n.png"].parts] == ["x" * 8, "x" * 9] or all(set(p.text) == {"x"} for p in got["n.png"].parts)
    assert got["n.png"].parts[0].provenance.bbox.y < got["n.png"].parts[1].provenance.bbox.y
    assert got["n.png"].pipeline[1].step == "recognition"
    s = extraction.summary(extraction.extract(corpus, cfg)).first()
    assert (s.files, s.succeeded, s.failed) == (18, 10, 8)


def test_flags(corpus):
    none = extraction.extract(corpus, extraction.ExtractionConfig(metadata=False))
    rows = {r.path: r for r in none.collect()}
    assert rows["j.txt"].error.kind == "NoContents"
    assert (rows["a.md"].metadata, rows["a.md"].pipeline, rows["a.md"].text, rows["a.md"].parts) == (None, [], None, None)
    only = {r.path: r for r in extraction.extract(corpus, extraction.ExtractionConfig()).collect()}
    assert only["a.md"].metadata.label == "markdown"
    assert only["g.zip"].error is None
    assert len(only["g.zip"].pipeline) == 1
    text = {r.path: r for r in extraction.extract(corpus, extraction.ExtractionConfig(metadata=False, content=True)).collect()}
    assert (text["b.html"].metadata, text["b.html"].text, text["b.html"].parts) == (None, "Hi & bye", None)
    assert text["n.png"].error.message == "no text recognition models are given"


def test_json_and_text_sinks(corpus, tmp_path, spark):
    out = extraction.extract(corpus.filter("path = 'a.md'"), extraction.ExtractionConfig.from_flags())
    j = extraction.as_documents(out).first().json
    assert '"text":"# raw *text*\\n"' in j
    assert '"provenance"' not in j
    files.write_json(out, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 1
    files.write_text(out, f"{tmp_path}/t")
    with pytest.raises(Exception, match="no text to write"):
        files.write_text(extraction.extract(corpus.filter("path = 'g.zip'"), extraction.ExtractionConfig(content=True)), f"{tmp_path}/u")


def test_classifier(spark, corpus):
    model = StandInClassifier()
    rows = {r.path: r for r in detection.detect_types(corpus, model).collect()}
    assert (rows["a.md"].origin, rows["j.txt"].label, rows["j.txt"].origin) == ("rule", "txt", "rule")
    assert rows["f.pdf"].origin == "model"
    assert rows["i.bin"].label == "unknown"
    one = {p: detection.detect_types(corpus.filter(F.col("path") == p), model).first().label for p in ("f.pdf", "b.html")}
    assert one == {p: rows[p].label for p in one}
    strict = StandInClassifier(thresholds_of=tuple((x, 0.95) for x in model.labels))
    assert detection.detect_types(corpus.filter("path = 'f.pdf'"), strict).first().label in ("txt", "unknown")
    with pytest.raises(FileNotFoundError):
        asset("/nowhere/model.onnx")
    assert Classifier("x", ("a",)).thresholds == {}


def test_directory(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/c.log", ".hidden", "skip/d.txt", "sub/deep/e.tmp", "keep.log"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    rules = ["# no", "*.log", "!keep.log", "skip/", "sub/**/*.tmp"]
    rows = files.read_directory(spark, str(tmp_path), rules).orderBy("relative").collect()
    assert [r.relative for r in rows] == ["a.txt", "keep.log", "sub/b.txt"]
    (tmp_path / ".ignore").write_text("\n".join(rules))
    assert files.read_directory(spark, str(tmp_path)).count() == 3
    assert files.checked(files.read_files(spark, str(tmp_path / "a.txt"))).first().error is None
    with pytest.raises(Exception, match="[Pp]ath"):
        files.read_files(spark, str(tmp_path / "nowhere")).count()


def test_nested_ignore_files(spark, tmp_path):
    written = {
        "a.log": "x", "b.txt": "x", "sub/a.log": "x", "sub/b.txt": "x", "sub/deep/c.log": "x", "sub/deep/d.txt": "x", "out/kept.txt": "x", "g.tmp": "x", "sub/g.tmp": "x", "x/y/z/w.txt": "x",
        ".ignore": "*.log\nout/\n!out/kept.txt\n/b.txt", "sub/.ignore": "!a.log\n/b.txt", "x/y/.ignore": "z/", ".gitignore": "*.tmp",
    }
    for name, text in written.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    walked = lambda: [r.relative for r in files.read_directory(spark, str(tmp_path)).orderBy("relative").collect()]
    assert walked() == ["g.tmp", "sub/a.log", "sub/deep/d.txt", "sub/g.tmp"]
    (tmp_path / ".git").mkdir()
    assert walked() == ["sub/a.log", "sub/deep/d.txt"]


def test_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.md").write_text("one")
    index_stream(spark, src, out, mark).awaitTermination(120)
    (tmp_path / "src/b.md").write_text("two")
    index_stream(spark, src, out, mark).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_embed_and_rerank(spark):
    df = spark.createDataFrame([(0, " a b "), (1, None), (2, "a b"), (3, "c")], "index int, text string")
    v = {r["index"]: r.embedding for r in embedding.embed(df, StandInText(), batch=2).collect()}
    assert v[1] is None
    assert v[0] == v[2]
    assert abs(np.linalg.norm(v[3]) - 1) < 1e-6
    with pytest.raises(ValueError, match="batch_size"):
        embedding.embed(df, StandInText(), batch=0)
    out = reranking.rerank(df.withColumnRenamed("text", "document"), "a b", StandInText(), k=2, normalize=True).collect()
    assert [r["index"] for r in out] == [0, 2]
    with pytest.raises(ValueError, match="top_k"):
        reranking.rerank(df, "a", StandInText(), k=0)
    ids, mask = padded([[5, 6], [7]], 1)
    assert (ids.tolist(), mask.tolist()) == ([[5, 6], [7, 1]], [[1, 1], [1, 0]])
    h = np.array([[[3.0, 0.0], [1.0, 4.0]]], np.float32)
    assert np.allclose(pooled(h, np.array([[1, 0]]), "mean"), [[1, 0]])
    assert len(ENCODERS) == 7


def test_ocr_and_layout(spark):
    df = spark.createDataFrame([(1, bytearray(image())), (2, bytearray(b"no image")), (3, None)], "id int, content binary")
    got = {r.id: r for r in ocr.ocr(df, StandInOcr()).collect()}
    assert len(got[1].page.blocks) == 2
    assert got[1].page.width == 736
    assert abs(got[1].page.blocks[0].confidence - 0.9) < 1e-6
    assert got[2].fault == "not a PNG image"
    assert (got[3].page, got[3].fault) == (None, None)
    for overlap in (None, 0.5):
        page = {r.id: r for r in layout.detect_layout(df, StandInLayout(), overlap=overlap).collect()}[1].page
        assert [(b.label, b.order) for b in page.blocks] == [("text", 0), ("doc_title", 1)] or [(b.label, b.order) for b in page.blocks] == [("doc_title", 0), ("text", 1)]
        assert page.blocks[0].bbox.width == pytest.approx(0.8 * 736, rel=1e-5)
