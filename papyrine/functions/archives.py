"""Text of zipped documents, with the standard library."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from .markup import visible_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _root(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations aren't read")
    return ElementTree.fromstring(data)


def epub_text(content: bytes) -> str:
    """The chapters in spine order, each a line, without white space at the ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = next(e.get("full-path") for e in _root(z, "META-INF/container.xml").iter() if e.tag.endswith("}rootfile"))
        opf = _root(z, package)
        items = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in opf.iter() if e.tag.endswith("}itemref")]
        base = posixpath.dirname(package)
        texts = [visible_text(z.read(posixpath.normpath(posixpath.join(base, unquote(h)))).decode()) for h in spine]
    return "".join(f"{t}\n" for t in texts).strip()


def docx_text(content: bytes) -> str:
    """A line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _root(z, "word/document.xml")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    lines = ["".join((e.text or "") if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter()) for p in body.iter(f"{_W}p")]
    return "\n".join(lines).strip()


def pptx_text(content: bytes) -> str:
    """A line for each paragraph of the slides, which an empty line parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = {e.get("Id"): e.get("Target") for e in _root(z, "ppt/_rels/presentation.xml.rels")}
        ids = [e.get(f"{_R}id") for e in _root(z, "ppt/presentation.xml").iter() if e.tag.endswith("}sldId")]
        slides = [_root(z, posixpath.normpath(posixpath.join("ppt", rels[i].lstrip("/").removeprefix("ppt/")))) for i in ids]
    pages = ["\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in s.iter(f"{_A}p")) for s in slides]
    return "\n\n".join(pages).strip()
