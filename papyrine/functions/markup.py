"""Visible text of markup.

Nearly all markup goes through a chain of patterns inside the JVM. What the chain can't express (CDATA, numeric
references, prefixed raw-text elements, document types with a subset, markup with a fault) goes through a tokenizer
in Arrow batches; the other rows are null there and cost nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Named references that are decoded; others stay as they are.
NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}

_ATTRS = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_HIDDEN = rf"<(?i:(script|style))(?=[\s>]){_ATTRS}(?<!/)>(?s:.*?)(?:</(?i:\{{0}})(?=[\s/>]|\z)[^>]*(?:>|\z)|\z)"
_TAG = rf"</[^>]*+>|<(?![!?/]){_ATTRS}>"
_SILENT = r"<!--(?s:.*?)-->|<!(?i:doctype)[^>\[]*+>|<\?(?s:.*?)\?>"
_WHITE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_REFERENCE = re.compile(r"&([^;&<]*);")


class MarkupError(ValueError):
    """Markup that can't be read on."""


def _decoded(m: re.Match) -> str:
    name = m[1]
    if not name.startswith("#"):
        return NAMED.get(name, m[0])
    try:
        code = int(name[2:], 16) if name.startswith("#x") else int(name[1:])
        if code == 0 or 0xD800 <= code < 0xE000 or not re.fullmatch(r"#x[0-9A-Fa-f]+|#[0-9]+", name):
            raise ValueError
        return chr(code)
    except (ValueError, OverflowError):
        raise MarkupError(f"bad character reference: {m[0]}") from None


def _past(s: str, mark: str, start: int) -> int:
    at = s.find(mark, start)
    if at < 0:
        raise MarkupError(f"missing {mark}")
    return at + len(mark)


def _past_doctype(s: str, at: int) -> int:
    inside = False
    for i in range(at, len(s)):
        if s[i] == "[":
            inside = True
        elif s[i] == "]":
            inside = False
        elif s[i] == ">" and not inside:
            return i + 1
    raise MarkupError("unclosed document type")


def _past_start_tag(s: str, at: int) -> int:
    quote = ""
    for i in range(at, len(s)):
        if quote:
            quote = "" if s[i] == quote else quote
        elif s[i] in "'\"":
            quote = s[i]
        elif s[i] == ">":
            return i + 1
    raise MarkupError("unclosed tag")


def visible_text(s: str) -> str:
    """Text of markup by a tokenizer; MarkupError where the markup is at fault."""
    out, i = [], 0
    while i < len(s):
        j = s.find("<", i)
        out.append(_REFERENCE.sub(_decoded, s[i : j if j >= 0 else len(s)]))
        if j < 0:
            break
        if s.startswith("<!--", j):
            i = _past(s, "-->", j + 4)
        elif s.startswith("<![CDATA[", j):
            i = _past(s, "]]>", j + 9)
            out.append(s[j + 9 : i - 3])
        elif s[j : j + 9].upper() == "<!DOCTYPE":
            i = _past_doctype(s, j + 9)
        elif s.startswith("<!", j):
            raise MarkupError("unknown declaration")
        elif s.startswith("<?", j):
            i = _past(s, "?>", j + 2)
        else:
            closing = s.startswith("</", j)
            i = _past(s, ">", j) if closing else _past_start_tag(s, j + 1)
            out.append(" ")
            body = s[j + 1 : i - 1]
            name = re.match(r"\S*", body)[0]
            if not closing and not body.endswith("/") and name.partition(":")[2 if ":" in name else 0].lower() in ("script", "style"):
                end = re.compile(rf"</{re.escape(name)}(?=[\t\n\x0c\r />]|\Z)", re.IGNORECASE | re.ASCII).search(s, i)
                close = s.find(">", end.start()) if end else -1
                if close < 0:
                    break
                i = close + 1
    return _WHITE.sub(" ", "".join(out)).strip(" ")


def _exact(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        try:
            rows.append((None if x is None else visible_text(x), None))
        except MarkupError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["text", "fault"])


def _without_marks(c: Column) -> Column:
    hidden = _HIDDEN.replace("{0}", "2")
    c = F.regexp_replace(c, rf"({hidden}|{_TAG})|{_SILENT}", "$1")
    c = F.regexp_replace(c, _HIDDEN.replace("{0}", "1"), " ")
    return F.regexp_replace(c, _TAG, " ")


def fast_text(c: Column) -> Column:
    """The pattern chain alone."""
    c = _without_marks(c)
    for name in sorted(NAMED, key=lambda n: n == "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(NAMED[name]))
    return collapse(c)


def needs_tokenizer(c: Column) -> Column:
    odd = r"<!\[CDATA\[|&#|(?i)<!doctype[^>]*\[|<[^\s<>/:]*+:(?:script|style)[\s>]"
    return c.rlike(odd) | _without_marks(c).contains("<")


def markup_text(c: Column) -> Column:
    """struct(text, fault): visible text, or what is wrong with the markup. Nulls for null."""
    exact = F.pandas_udf(_exact, "struct<text:string,fault:string>")(F.when(needs_tokenizer(c), c))
    text = F.coalesce(exact["text"], F.when(exact["fault"].isNull(), fast_text(c)))
    return F.struct(text.alias("text"), exact["fault"].alias("fault"))
