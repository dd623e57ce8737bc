"""Text recognition: image, boxes of text, crops, characters."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import imaging as I
from ..functions.jpeg import decode_jpeg
from ..providers import OcrModels, loaded
from ..schema import OCR_PAGE, null

BATCH = 16


def decoded(content: bytes) -> np.ndarray:
    """RGB pixels of a PNG or JPEG image; other formats are a ValueError."""
    return decode_jpeg(content) if content[:2] == b"\xff\xd8" else I.decode_png(content)


def page_of(pixels: np.ndarray, models: OcrModels) -> dict:
    """The page of an image: blocks of text in reading order; crops of one width are read together."""
    engine = loaded(models)
    h, w = pixels.shape[:2]
    boxes = G.text_boxes(engine.map(I.detector_input(pixels)), w, h, least_mean=models.least_mean)
    points = [np.array([[l, t], [r, t], [r, b], [l, b]], np.float32) for l, t, r, b in boxes]  # noqa: E741
    inputs = [I.recogniser_input(I.crop(pixels, p)) for p in points]
    texts: list = [None] * len(inputs)
    widths = np.array([x.shape[2] for x in inputs])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        for i in range(0, len(own), BATCH):
            some = own[i : i + BATCH]
            scores = engine.read(np.stack([inputs[k] for k in some]))
            if len(scores) != len(some):
                raise ValueError("the recogniser gave another number of crops than it got")
            for k, s in zip(some, scores, strict=True):
                texts[k] = read_text(s, engine.characters)
    blocks = []
    for (l, t, r, b), (text, sure) in zip(boxes.tolist(), texts, strict=True):  # noqa: E741
        if text.strip():
            blocks.append({"text": text.strip(), "bbox": {"x": l, "y": t, "width": r - l, "height": b - t}, "confidence": sure, "kind": "text"})
    return {"width": w, "height": h, "blocks": blocks}


def read_text(scores: np.ndarray, characters: list[str]) -> tuple[str, float]:
    """Text and confidence of one crop: best classes without blanks (0) and repeats."""
    best, top = G.ctc_best(scores, len(characters) + 1)
    new = (best != 0) & np.concatenate([[True], best[1:] != best[:-1]]) & (best <= len(characters))
    return "".join(characters[i - 1] for i in best[new]), float(top[new].mean(dtype=np.float64)) if new.any() else 0.0


def recognised(images: DataFrame, models: OcrModels | None, content: str = "content", out: str = "page") -> DataFrame:
    """images with a column struct(page, fault, ms); null contents stay null and cost nothing.

    Without models every image is a fault: nothing is guessed.
    """
    kind = f"struct<page:{OCR_PAGE},fault:string,ms:bigint>"
    if models is None:
        none = F.struct(null(OCR_PAGE).alias("page"), F.lit("no text recognition models are given").alias("fault"), F.lit(0).cast("bigint").alias("ms"))
        return images.withColumn(out, F.when(F.col(content).isNotNull(), none))

    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            began, page, fault = time.perf_counter(), None, None
            if x is not None:
                try:
                    page = page_of(decoded(x), models)
                except ValueError as e:
                    fault = str(e)
            rows.append((page, fault, int((time.perf_counter() - began) * 1000)))
        return pd.DataFrame(rows, columns=["page", "fault", "ms"])

    return images.withColumn(out, F.pandas_udf(run, kind)(F.col(content)))


def ocr(images: DataFrame, models: OcrModels) -> DataFrame:
    """images (content, ...) with page and fault; content is dropped."""
    rest = [c for c in images.columns if c != "content"]
    return recognised(images, models, "content", "_ocr").select(*rest, F.col("_ocr.page").alias("page"), F.col("_ocr.fault").alias("fault"))


def pipeline_report(models: OcrModels) -> dict[str, str]:
    """Which models run."""
    return {"detection_model": getattr(models, "detector", models.tier), "recognition_model": getattr(models, "recogniser", models.tier)}
