"""Pixels as numpy arrays (height, width, 3): PNG decoding, fixed-point resizing, crops, tensors."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 2048
# Channel means and deviations of the text detector's and recogniser's inputs.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def decode_png(data: bytes) -> np.ndarray:
    """RGB pixels of a PNG of 8 or 16 bits or a palette, not interlaced; alpha is dropped. ValueError for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None:
        raise ValueError("PNG without a header")
    w, h, depth, color, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlace or (depth < 8 and color not in (0, 3)):
        raise ValueError("unsupported PNG variant")
    stride, bpp = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from None
    if len(raw) != h * (stride + 1):
        raise ValueError("PNG of another size than its header says")
    raw = raw.reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].copy()
        if kind == 1 and stride % bpp == 0:
            line = np.add.accumulate(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            own, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, b, c = (own[i - bpp], up[i], up[i - bpp]) if i >= bpp else (0, up[i], 0)
                near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
                own[i] = (own[i] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
            line = np.array(own, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = above = line
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, :w]
        values = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :, None]
        values = values if color == 3 else (values * (255 // (2**depth - 1))).astype(np.uint8)
    else:
        values = out.reshape(h, w, channels, depth // 8)[..., 0]
    if color == 3:
        if palette is None:
            raise ValueError("PNG without a palette")
        return palette[values[..., 0]]
    return np.repeat(values[..., :1], 3, axis=2) if channels < 3 else values[..., :3].copy()


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _linear(out: int, n: int) -> tuple[np.ndarray, ...]:
    """Two source places and weights of 2048 for each output place."""
    at = ((np.arange(out) + 0.5) * (n / out) - 0.5).astype(np.float32)
    low = np.floor(at).astype(np.int64)
    part = (at - low.astype(np.float32)).astype(np.float32)
    part[(low < 0) | (low >= n - 1)] = 0
    low = np.clip(low, 0, n - 1)
    return low, np.minimum(low + 1, n - 1), np.rint((np.float32(1) - part) * np.float32(SCALE)).astype(np.int64), np.rint(part * np.float32(SCALE)).astype(np.int64)


def resize_linear(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear in fixed point: sums are cut to 16 bits after each direction."""
    p = pixels.astype(np.int64)
    a, b, wa, wb = _linear(width, p.shape[1])
    rows = np.clip((p[:, a] * wa[:, None] + p[:, b] * wb[:, None]) >> 4, -32768, 32767)
    a, b, wa, wb = _linear(height, p.shape[0])
    both = np.clip(((rows[a] * wa[:, None, None]) >> 16) + ((rows[b] * wb[:, None, None]) >> 16), -32768, 32767)
    return np.clip((both + 2) >> 2, 0, 255).astype(np.uint8)


def cubic_weights(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Weights of the four neighbours of a place, x past the second one."""
    far = lambda d: a * (((d - 5) * d + 8) * d - 4)
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    w = [far(x + 1), near(x), near(1 - x)]
    return np.stack([*w, 1 - w[0] - w[1] - w[2]], axis=-1)


def resize_cubic(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic (a = -0.75) in fixed point."""

    def taps(out: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(out) + 0.5) * (n / out) - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low[:, None] + np.arange(-1, 3), 0, n - 1), np.rint(cubic_weights(at - low) * SCALE).astype(np.int64)

    p = pixels.astype(np.int64)
    at, w = taps(width, p.shape[1])
    rows = (p[:, at] * w[None, :, :, None]).sum(axis=2)
    at, w = taps(height, p.shape[0])
    both = (rows[at] * w[:, :, None, None]).sum(axis=1)
    return np.clip((both + (1 << 21)) >> 22, 0, 255).astype(np.uint8)


def crop(pixels: np.ndarray, points: np.ndarray, upright: float = 1.5) -> np.ndarray:
    """The quadrilateral's content (corners truncated to whole pixels), turned by 270 degrees if it is upright."""
    p = np.trunc(np.asarray(points, np.float32)).astype(np.float32)
    side = lambda i, j: np.sqrt(((p[j] - p[i]) ** 2).sum(dtype=np.float32))
    w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if not w or not h:
        raise ValueError("crop without an area")
    u, v = (np.arange(w, dtype=np.float32) / np.float32(w))[None, :, None], (np.arange(h, dtype=np.float32) / np.float32(h))[:, None, None]
    top, bottom = p[0] + (p[1] - p[0]) * u, p[3] + (p[2] - p[3]) * u
    at = top + (bottom - top) * v
    low = np.floor(at).astype(np.int64)
    part = (at - low).astype(np.float32)
    wx, wy = (cubic_weights(part[..., i]).astype(np.float32) for i in (0, 1))
    out = np.zeros((h, w, 3), np.float32)
    for ky in range(4):
        y = np.clip(low[..., 1] + ky - 1, 0, pixels.shape[0] - 1)
        for kx in range(4):
            x = np.clip(low[..., 0] + kx - 1, 0, pixels.shape[1] - 1)
            out += pixels[y, x].astype(np.float32) * (wx[..., kx] * wy[..., ky])[..., None]
    out = np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
    return np.rot90(out, 1).copy() if h / w >= upright else out


def tensor(pixels: np.ndarray, mean: tuple = MEAN, std: tuple = STD, width: int | None = None, reverse: bool = True) -> np.ndarray:
    """Channels first, normalised, blue first if reverse; padded with zeros to the width."""
    x = pixels[..., ::-1] if reverse else pixels
    x = ((x.astype(np.float32) / np.float32(255) - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)
    return np.pad(x, ((0, 0), (0, 0), (0, max(0, (width or 0) - x.shape[2]))))


def detector_size(width: int, height: int, least: int = 736, most: int = 4000) -> tuple[int, int]:
    """The short side is scaled up to ``least``, the long side capped at ``most``, both snapped to 32, half to even."""
    w, h = float(max(width, 1)), float(max(height, 1))
    up = max(1.0, least / min(w, h))
    w, h = float(int(w * up)), float(int(h * up))
    if max(w, h) > most:
        down = most / max(w, h)
        w, h = float(int(w * down)), float(int(h * down))
    return max(32, round(w / 32) * 32), max(32, round(h / 32) * 32)


def recogniser_input(pixels: np.ndarray, height: int = 48, least: int = 320, most: int = 3200) -> np.ndarray:
    """A crop at the recogniser's height, at least ``least`` wide."""
    scale = np.float32(height) / np.float32(max(1, pixels.shape[0]))
    width = min(max(1, int(np.ceil(np.float32(pixels.shape[1]) * scale))), most)
    return tensor(resize_linear(pixels, width, height), width=max(width, least))


def detector_input(pixels: np.ndarray, least: int = 736, most: int = 4000) -> np.ndarray:
    w, h = detector_size(pixels.shape[1], pixels.shape[0], least, most)
    return tensor(resize_linear(pixels, w, h))


def layout_input(pixels: np.ndarray, side: int = 800) -> np.ndarray:
    return tensor(resize_cubic(pixels, side, side), (0, 0, 0), (1, 1, 1), reverse=False)
