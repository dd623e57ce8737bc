"""JPEG decoding with numpy: baseline, extended and progressive Huffman files of 8 bits, grey, YCbCr, RGB or CMYK."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# The zigzag order, from the place in a stream to the place in a block.
ZIGZAG = [i * 8 + s - i if s % 2 else (s - i) * 8 + i for s in range(15) for i in range(max(0, s - 7), min(s, 7) + 1)]
_FRAMES = {0xC0: False, 0xC1: False, 0xC2: True}
_UNREAD = {0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
_BASIS = np.array([[(0.5 if k else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    stride: int = 0
    coefficients: list[int] = field(default_factory=list)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) for each next 16 bits; length 0 where there is no code."""
    table: list[tuple[int, int]] = []
    at = 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            table += [(length, s)] * (1 << (16 - length))
        at += n
    if len(table) > 1 << 16:
        raise ValueError("damaged JPEG: too many codes")
    return table + [(0, 0)] * ((1 << 16) - len(table))


class _Bits:
    """Bits of one restart interval; past its end they are 0."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, len(data) * 8 + 32

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        i, d = self.at >> 3, self.data
        if self.at > self.end:
            raise ValueError("damaged JPEG: data end too early")
        x = (d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (24 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return x

    def symbol(self, table: list[tuple[int, int]]) -> int:
        i, d = self.at >> 3, self.data
        if self.at > self.end:
            raise ValueError("damaged JPEG: data end too early")
        length, s = table[(d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (self.at & 7)) & 0xFFFF]
        if not length:
            raise ValueError("damaged JPEG: unknown code")
        self.at += length
        return s

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if n == 0 or x >> (n - 1) else x - (1 << n) + 1


@dataclass
class _Scan:
    """Parameters of a scan and what runs on from block to block."""

    first: int
    last: int
    high: int
    low: int
    progressive: bool
    dc: dict
    ac: dict
    before: dict = field(default_factory=dict)
    skip: int = 0

    def block(self, bits: _Bits, c: Component, at: int) -> None:
        out = c.coefficients
        if self.first == 0:
            if self.high:
                out[at] |= bits.take(1) << self.low
            else:
                n = bits.symbol(self.dc[c.id])
                if n > 15:
                    raise ValueError("damaged JPEG: a difference is too large")
                self.before[c.id] = self.before.get(c.id, 0) + bits.signed(n)
                out[at] = self.before[c.id] * (1 << self.low)
        if self.last:
            (self.refine if self.high else self.ac_first)(bits, out, at, self.ac[c.id])

    def ac_first(self, bits: _Bits, out: list[int], at: int, table: list) -> None:
        if self.skip:
            self.skip -= 1
            return
        k = max(1, self.first)
        while k <= self.last:
            s = bits.symbol(table)
            run, n = s >> 4, s & 15
            if n:
                k += run
                if k > 63:
                    raise ValueError("damaged JPEG: a block is too long")
                out[at + ZIGZAG[k]] = bits.signed(n) * (1 << self.low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + bits.take(run) if self.progressive else 0
                return

    def refine(self, bits: _Bits, out: list[int], at: int, table: list) -> None:
        """One more bit of the coefficients that are known, between new ones of one bit."""
        k, step = self.first, 1 << self.low

        def known(place: int) -> bool:
            x = out[place]
            if x and bits.take(1) and not abs(x) & step:
                out[place] += step if x > 0 else -step
            return x != 0

        while k <= self.last and not self.skip:
            s = bits.symbol(table)
            run, new = s >> 4, 0
            if s & 15:
                new = step if bits.take(1) else -step
            elif run < 15:
                self.skip = (1 << run) + bits.take(run)
                break
            while k <= self.last:
                place = at + ZIGZAG[k]
                k += 1
                if not known(place):
                    if run == 0:
                        if new:
                            out[place] = new
                        break
                    run -= 1
        if self.skip:
            for j in range(k, self.last + 1):
                known(at + ZIGZAG[j])
            self.skip -= 1


def _frame(body: bytes) -> tuple[int, int, list[Component]]:
    """Width, height and components, with room for their coefficients."""
    depth, h, w, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not w or not h or n not in (1, 3, 4):
        raise ValueError("unsupported JPEG variant")
    parts = [Component(i, hv >> 4, hv & 15, q) for i, hv, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
    if any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
        raise ValueError("damaged JPEG: sampling factors")
    wide, high = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.across, c.down = -(-(-(-w * c.h // wide)) // 8), -(-(-(-h * c.v // high)) // 8)
        c.stride = -(-w // (8 * wide)) * c.h
        c.coefficients = [0] * (64 * c.stride * -(-h // (8 * high)) * c.v)
    return w, h, parts


def _read(scan: _Scan, parts: list[Component], units: list[list[tuple[Component, int]]], data: bytes, every: int) -> None:
    intervals = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)]
    every = every or len(units)
    if len(intervals) < -(-len(units) // every):
        raise ValueError("damaged JPEG: restart intervals are missing")
    for i, start in enumerate(range(0, len(units), every)):
        bits, scan.before, scan.skip = _Bits(intervals[i]), {}, 0
        for unit in units[start : start + every]:
            for c, at in unit:
                scan.block(bits, c, at)


def _units(parts: list[Component], w: int, h: int, wide: int, high: int) -> list[list[tuple[Component, int]]]:
    """The blocks of each coded unit: those under one another of several components, or single blocks of one."""
    if len(parts) == 1:
        c = parts[0]
        return [[(c, 64 * (y * c.stride + x))] for y in range(c.down) for x in range(c.across)]
    return [
        [(c, 64 * ((my * c.v + y) * c.stride + mx * c.h + x)) for c in parts for y in range(c.v) for x in range(c.h)]
        for my in range(-(-h // (8 * high))) for mx in range(-(-w // (8 * wide)))
    ]


def decode_jpeg(data: bytes) -> np.ndarray:
    """RGB pixels; subsampled colours are repeated. ValueError for arithmetic, lossless or damaged files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    quants: dict = {}
    dc: dict = {}
    ac: dict = {}
    frame, progressive, every, adobe, at, scanned = None, False, 0, None, 2, False
    try:
        while at + 4 <= len(data):
            if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF) or 0xD0 <= data[at + 1] <= 0xD8:
                at += 1
                continue
            kind = data[at + 1]
            if kind == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if at > len(data):
                raise ValueError("damaged JPEG: data end too early")
            if kind in _UNREAD:
                raise ValueError("unsupported JPEG variant")
            if kind in _FRAMES:
                frame, progressive = _frame(body), _FRAMES[kind]
            elif kind == 0xDB:
                while body:
                    size = 128 if body[0] >> 4 else 64
                    q = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8)
                    quants[body[0] & 15] = np.zeros(64)
                    quants[body[0] & 15][ZIGZAG] = q
                    body = body[1 + size :]
            elif kind == 0xC4:
                while body:
                    total = sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif kind == 0xDD:
                every = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif kind == 0xDA:
                w, h, every_part = frame
                own = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                parts = [c for c in every_part if c.id in own]
                first, last, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
                first, last, approx = (first, last, approx) if progressive else (0, 63, 0)
                if last > 63 or first > last or len(parts) != body[0]:
                    raise ValueError("damaged JPEG: scan")
                tables = lambda t, shift: {c.id: t.get(own[c.id] >> shift & 15) for c in parts}
                scan = _Scan(first, last, approx >> 4, approx & 15, progressive, tables(dc, 4), tables(ac, 0))
                stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                end = stop.start() if stop else len(data)
                _read(scan, parts, _units(parts, w, h, max(c.h for c in every_part), max(c.v for c in every_part)), data[at:end], every)
                at, scanned = end, True
        if not scanned:
            raise ValueError("JPEG without a picture")
        return _pixels(*frame, quants, adobe)
    except (IndexError, KeyError, TypeError, struct.error) as e:
        raise ValueError(f"damaged JPEG: {type(e).__name__}") from None


def _pixels(w: int, h: int, parts: list[Component], quants: dict, adobe: int | None) -> np.ndarray:
    wide, high = max(c.h for c in parts), max(c.v for c in parts)
    planes = []
    for c in parts:
        blocks = (np.array(c.coefficients, np.float64).reshape(-1, 64) * quants[c.quant]).reshape(-1, c.stride, 8, 8)
        plane = np.einsum("rcuv,uy,vx->rycx", blocks, _BASIS, _BASIS, optimize=True).reshape(-1, c.stride * 8) + 128
        rows, columns = np.arange(h) * c.v // high, np.arange(w) * c.h // wide
        planes.append(np.clip(plane[rows[:, None], columns], 0, 255))
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, axis=2)
    x, y, z = planes[:3]
    by_name = [c.id for c in parts] == [82, 71, 66]
    if adobe in (1, 2) or (adobe is None and len(planes) == 3 and not by_name):
        x, y, z = x + 1.402 * (z - 128), x - 0.344136 * (y - 128) - 0.714136 * (z - 128), x + 1.772 * (y - 128)
    rgb = np.clip(np.stack([x, y, z], axis=2), 0, 255)
    if len(planes) == 4:  # inks; the marker's program stores them inverted
        k = planes[3][:, :, None]
        rgb = rgb * k / 255 if adobe is not None else (255 - rgb) * (255 - k) / 255
    return np.rint(rgb).astype(np.uint8)
