"""JPEG decoding against the JVM's decoder."""

from __future__ import annotations

import numpy as np
import pytest

from papyrine.functions.imaging import decode_png, encode_png
from papyrine.functions.jpeg import decode_jpeg
from papyrine.operators.ocr import decoded


def coded(spark, pixels: np.ndarray, progressive: bool = False, grey: bool = False) -> tuple[bytes, np.ndarray]:
    """A JPEG of the JVM and what the JVM reads from it."""
    jvm = spark._jvm
    io, image = jvm.javax.imageio, jvm.java.awt.image.BufferedImage
    source = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(encode_png(pixels))))
    if grey:
        h, w = pixels.shape[:2]
        flat = image(w, h, 10)
        flat.getGraphics().drawImage(source, 0, 0, None)
        source = flat
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(io.ImageIO.createImageOutputStream(out))
    writer.write(None, io.IIOImage(source, None, None), param)
    writer.getOutput().flush()
    data = bytes(out.toByteArray())
    back = jvm.java.io.ByteArrayOutputStream()
    io.ImageIO.write(io.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))), "png", back)
    return data, decode_png(bytes(back.toByteArray()))


@pytest.mark.parametrize(("progressive", "grey"), [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("size", [(40, 56), (37, 51), (1, 1), (8, 130)])
def test_as_the_jvm_reads_it(spark, progressive: bool, grey: bool, size: tuple[int, int]) -> None:
    h, w = size
    y, x = np.mgrid[:h, :w]
    pixels = np.stack([x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h)], axis=2).astype(np.uint8)
    pixels[h // 4 : h // 2, w // 4 : w // 2] = 255 - pixels[h // 4 : h // 2, w // 4 : w // 2] // 2
    data, expected = coded(spark, pixels, progressive, grey)
    assert (b"\xff\xc2" in data) == progressive
    got = decoded(data)
    off = np.abs(got.astype(int) - expected)
    assert got.shape == (h, w, 3)
    assert off.max() <= 2 if grey else off.mean() <= 6  # the JVM smooths the subsampled colours between pixels


def test_damaged(spark) -> None:
    data, _ = coded(spark, np.full((16, 16, 3), 90, np.uint8))
    for bad in (b"", b"\xff\xd8", data[: len(data) // 2], data[:-40], b"\xff\xd8\xff\xc3\x00\x04ab", b"\xff\xd8\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"):
        with pytest.raises(ValueError):
            decode_jpeg(bad)
    assert (decode_jpeg(data) == 90).all()
    assert (decode_jpeg(data[:-2]) == 90).all()  # without an end marker
