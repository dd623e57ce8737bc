"""Text of legacy word processor files: compound files of sectors, and the piece table of the document in them."""

from __future__ import annotations

import re
import struct

_SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Control characters of the format, and what they are in a text.
_MARKS = {"\r": "\n", "\x07": "\t", "\x0b": "\n", "\x0c": "\n", "\x0e": "\n", "\x1e": "-"}


def _chain(table: list[int], first: int) -> list[int]:
    """Numbers of sectors from ``first`` on; ValueError where they run in a circle or out of the table."""
    out, at = [], first
    while at < 0xFFFFFFFA:
        if at >= len(table) or len(out) > len(table):
            raise ValueError("damaged compound file: chain of sectors")
        out.append(at)
        at = table[at]
    return out


def streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name; of those that share a name in several storages the first."""
    if content[:8] != _SIGNATURE or len(content) < 512:
        raise ValueError("not a compound file")
    try:
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        directory, _, cutoff, mini_first, _, more, _ = struct.unpack_from("<7I", content, 48)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("damaged compound file: size of sectors")
        size = 1 << shift
        sector = lambda n: content[(n + 1) * size : (n + 2) * size]
        numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
        fat_at, seen = numbers(content[76:512]), set()
        while more < 0xFFFFFFFA and more not in seen:
            seen.add(more)
            *some, more = numbers(sector(more))
            fat_at += some
        fat = [x for n in fat_at if n < 0xFFFFFFFA for x in numbers(sector(n))]
        whole = lambda first: b"".join(sector(n) for n in _chain(fat, first))
        entries = whole(directory)
        mini_fat = numbers(whole(mini_first))
        out: dict[str, bytes] = {}
        mini = b""
        for at in range(0, len(entries) - 127, 128):
            n, kind = struct.unpack_from("<HB", entries, at + 64)
            first, length = struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                mini = whole(first)[:length]
            elif kind == 2:
                small = length < cutoff
                data = b"".join(mini[k * 64 : k * 64 + 64] for k in _chain(mini_fat, first)) if small else whole(first)
                out.setdefault(entries[at : at + max(0, n - 2)].decode("utf-16-le"), data[:length])
    except (struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"damaged compound file: {e}") from None
    return out


def _pieces(table: bytes, text: bytes) -> str:
    """The characters that a piece table (the last part of ``table``) finds in ``text``."""
    at = 0
    while table[at] == 1:  # formats of pieces
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if table[at] != 2:
        raise ValueError("damaged document: no piece table")
    n = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    out = []
    for i in range(n):
        place, chars = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0], ends[i + 1] - ends[i]
        start = (place & 0x3FFFFFFF) // (2 if place & 0x40000000 else 1)
        own = text[start : start + chars * (1 if place & 0x40000000 else 2)]
        out.append("".join(bytes([b]).decode("cp1252", "replace") for b in own) if place & 0x40000000 else own.decode("utf-16-le", "replace"))
    return "".join(out)


def doc_text(content: bytes) -> str:
    """The main text of a document of the 97 to 2003 format, a line for each paragraph; of fields only the result."""
    found = streams(content)
    text = found.get("WordDocument", b"")
    try:
        if struct.unpack_from("<H", text)[0] != 0xA5EC:
            raise ValueError("no word processor document")
        version, flags = struct.unpack_from("<H", text, 2)[0], struct.unpack_from("<H", text, 10)[0]
        if version < 0xC1:
            raise ValueError("documents before the 97 format aren't read")
        if flags & 0x100:
            raise ValueError("encrypted document")
        length, (at, size) = struct.unpack_from("<I", text, 76)[0], struct.unpack_from("<II", text, 418)
        raw = _pieces(found.get("1Table" if flags & 0x200 else "0Table", b"")[at : at + size], text)
    except (struct.error, IndexError) as e:
        raise ValueError(f"damaged document: {e}") from None
    # characters of the file count in units of 16 bits
    raw = raw.encode("utf-16-le", "surrogatepass")[: 2 * length].decode("utf-16-le", "replace")
    out, fields = [], []
    for c in raw:
        if c == "\x13":
            fields.append(True)
        elif c == "\x14" and fields:
            fields[-1] = False
        elif c == "\x15" and fields:
            fields.pop()
        elif not any(fields):
            out.append(_MARKS.get(c, "" if c < " " and c not in "\t\n" or c == "\x1f" else c))
    return re.sub(r"[ \t]+\n", "\n", "".join(out)).strip()
