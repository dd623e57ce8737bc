"""Page layout: image to labelled blocks in reading order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import imaging as I
from ..providers import LayoutModel, loaded
from ..schema import LAYOUT_PAGE
from .ocr import decoded

RAW = "struct<width:int,height:int,logits:array<array<float>>,boxes:array<array<float>>,orders:array<int>,fault:string>"


def layout_blocks(raw: Column, least: float = 0.5, most: int = 300) -> Column:
    """The page's blocks, in reading order, from a struct of a model's raw outputs."""
    found = G.layout_candidates(raw["logits"], raw["boxes"], raw["orders"], raw["width"], raw["height"], least, most)
    block = lambda d: F.struct(d["label"].alias("label"), d["score"].alias("confidence"), G.extent_box(d["left"], d["top"], d["right"], d["bottom"]).alias("bbox"), d["order"].alias("order"))
    return F.transform(G.in_reading_order(found), block)


def surviving(logits: np.ndarray, boxes: np.ndarray, width: int, height: int, least: float, most: int, overlap: float) -> np.ndarray:
    """logits with those of detections at minus infinity that overlap a better one by more than ``overlap``.

    What is dropped depends on what was kept before, so it is done here, where the page's detections are together.
    """
    score = (1 / (1 + np.exp(-logits.astype(np.float64)))).astype(np.float32)
    p, c = np.nonzero(score >= least)
    order = np.lexsort((c, p, -score[p, c]))[:most]
    p, c = p[order], c[order]
    edges = np.concatenate([boxes[p, :2] - boxes[p, 2:] / 2, boxes[p, :2] + boxes[p, 2:] / 2], axis=1) * np.array([width, height, width, height])
    edges = np.clip(edges, 0, [width, height, width, height])
    names = np.array([G.LAYOUT_LABELS[i] if i < len(G.LAYOUT_LABELS) else str(i) for i in c])
    order = np.lexsort((names, edges[:, 2], edges[:, 3], edges[:, 0], edges[:, 1], -score[p, c]))
    kept = order[G.suppressed(edges[order], overlap)]
    out = np.full_like(logits, -np.inf)
    out[p[kept], c[kept]] = logits[p[kept], c[kept]]
    return out


def detect_layout(images: DataFrame, model: LayoutModel, least: float = 0.5, most: int = 300, overlap: float | None = None) -> DataFrame:
    """images (content, ...) with page and fault; content is dropped. The network runs in Python, its outputs are decoded in the JVM.

    overlap: drops what overlaps a better detection by more.
    """

    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for x in content:
            row = (None, None, None, None, None, None)
            if x is not None:
                try:
                    pixels = decoded(x)
                    logits, boxes, order = loaded(model).run(I.layout_input(pixels))
                    if overlap is not None:
                        logits = surviving(logits, boxes, pixels.shape[1], pixels.shape[0], least, most, overlap)
                    row = (pixels.shape[1], pixels.shape[0], logits.tolist(), boxes.tolist(), G.order_ranks(order).tolist(), None)
                except ValueError as e:
                    row = (None, None, None, None, None, str(e))
            rows.append(row)
        return pd.DataFrame(rows, columns=["width", "height", "logits", "boxes", "orders", "fault"]).astype({"width": "Int32", "height": "Int32"})

    rest = [c for c in images.columns if c != "content"]
    raw = images.withColumn("_raw", F.pandas_udf(run, RAW)("content"))
    page = F.struct(F.col("_raw.width").alias("width"), F.col("_raw.height").alias("height"), layout_blocks(F.col("_raw"), least, most).alias("blocks")).cast(LAYOUT_PAGE)
    return raw.select(*rest, F.when(F.col("_raw.width").isNotNull(), page).alias("page"), F.col("_raw.fault").alias("fault"))
