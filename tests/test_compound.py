"""Legacy documents from compound files made here."""

from __future__ import annotations

import struct

import pytest

from papyrine.functions.compound import doc_text, streams

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(parts: dict[str, bytes], cutoff: int = 4096) -> bytes:
    """A compound file of 512-byte sectors: sector 0 is the table, 1 the small table, 2 on the directory."""
    small = {k: v for k, v in parts.items() if len(v) < cutoff}
    mini, mini_fat, starts = b"", [], {}
    for k, v in small.items():
        n = max(1, -(-len(v) // 64))
        starts[k] = len(mini_fat)
        mini_fat += [len(mini_fat) + i + 1 for i in range(n - 1)] + [END]
        mini += v.ljust(n * 64, b"\0")
    names = ["Root Entry", *parts]
    fat, sectors = [FAT, END], [b"", struct.pack("<128I", *(mini_fat + [FREE] * (128 - len(mini_fat))))]

    def add(data: bytes) -> int:
        n, first = max(1, -(-len(data) // 512)), len(fat)
        fat.extend([first + i + 1 for i in range(n - 1)] + [END])
        sectors.extend(data[i * 512 : i * 512 + 512].ljust(512, b"\0") for i in range(n))
        return first

    directory = add(b"\0" * 128 * len(names))
    starts["Root Entry"] = add(mini)
    for k, v in parts.items():
        if k not in small:
            starts[k] = add(v)
    entries = b""
    for k in names:
        raw = k.encode("utf-16-le")
        length = len(mini) if k == "Root Entry" else len(parts[k])
        entries += raw.ljust(64, b"\0") + struct.pack("<HB", len(raw) + 2, 5 if k == "Root Entry" else 2).ljust(52, b"\0") + struct.pack("<II", starts[k], length) + b"\0\0\0\0"
    for i in range(-(-len(entries) // 512)):
        sectors[directory + i] = entries[i * 512 : i * 512 + 512].ljust(512, b"\0")
    sectors[0] = struct.pack("<128I", *(fat + [FREE] * (128 - len(fat))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<8I", 1, directory, 0, cutoff, 1, 1, END, 0)
    return head + struct.pack("<109I", *([0] + [FREE] * 108)) + b"".join(sectors)


def document(pieces: list[tuple[str, bool]], flags: int = 0x200, version: int = 0xC1, filler: int = 5000) -> bytes:
    head = bytearray(1024)
    struct.pack_into("<HH", head, 0, 0xA5EC, version)
    struct.pack_into("<H", head, 10, flags)
    text, ends, places = bytes(head), [0], b""
    for s, packed in pieces:
        raw = s.encode("cp1252" if packed else "utf-16-le")
        place = len(text) * 2 | 0x40000000 if packed else len(text)
        text += raw
        ends.append(ends[-1] + len(raw) // (1 if packed else 2))
        places += struct.pack("<HIH", 0, place, 0)
    body = struct.pack(f"<{len(ends)}I", *ends) + places
    table = b"\x01\x03\x00abc" + b"\x02" + struct.pack("<I", len(body)) + body
    text = bytearray(text + b"\0" * filler)
    struct.pack_into("<I", text, 76, ends[-1])
    struct.pack_into("<II", text, 418, 10, len(table))
    return compound({"WordDocument": bytes(text), "1Table" if flags & 0x200 else "0Table": b"\0" * 10 + table})


@pytest.mark.parametrize("filler", [0, 5000])
@pytest.mark.parametrize("flags", [0, 0x200])
def test_text(flags: int, filler: int) -> None:
    made = document([("First “line”\rcell\x07", True), ("Ж😀 \x13 HYPERLINK x \x14shown\x15\r", False), ("a\x0bb\x1e\x1fc\x08", True)], flags, filler=filler)
    assert doc_text(made) == "First “line”\ncell\tЖ😀 shown\na\nb-c"


def test_streams_and_damage() -> None:
    parts = {"a": b"x" * 100, "b": b"y" * 5000, "c": b""}
    assert streams(compound(parts)) == parts | {"c": b""}
    good = document([("text", True)])
    for bad in (b"", good[:8], good[:600], document([("x", True)], 0x300), document([("x", True)], version=0x65), compound({"other": b"x"}), compound({"WordDocument": b"\xec\xa5"})):
        with pytest.raises(ValueError):
            doc_text(bad)
