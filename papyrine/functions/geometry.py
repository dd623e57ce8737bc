"""Boxes: expressions where a box stands for itself, numpy where boxes of one image depend on each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the layout classes, by id.
LAYOUT_LABELS = [
    "abstract", "algorithm", "aside_text", "chart", "content", "formula", "doc_title", "figure_title", "footer",
    "footer", "footnote", "formula_number", "header", "header", "image", "formula", "number", "paragraph_title",
    "reference", "reference_content", "seal", "table", "text", "text", "vision_footnote",
]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap by union of two boxes (left, top, right, bottom); 0 where the union has no area."""
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    area = lambda x: side(x[0], x[2]) * side(x[1], x[3])
    common = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = area(a) + area(b) - common
    return F.when(union <= 0, F.lit(0.0)).otherwise(common / union)


def expanded(left: Column, top: Column, right: Column, bottom: Column, ratio: float, area: Column) -> list[Column]:
    """A box with each side moved out by area * ratio / perimeter; as it is if it has no perimeter."""
    around = 2 * ((right - left) + (bottom - top))
    by = F.when(around > 0, area * ratio / around).otherwise(F.lit(0.0))
    return [left - by, top - by, right + by, bottom + by]


def detector_size(width: Column, height: Column, least: int = 736, most: int = 4000) -> Column:
    """struct(width, height) of the text detector's input: scaled up, capped, snapped to 32, half to even."""
    w, h = F.greatest(width, F.lit(1)).cast("double"), F.greatest(height, F.lit(1)).cast("double")
    up = F.greatest(F.lit(1.0), least / F.least(w, h))
    w, h = F.floor(w * up).cast("double"), F.floor(h * up).cast("double")
    down = F.when(F.greatest(w, h) > most, most / F.greatest(w, h)).otherwise(F.lit(1.0))
    snap = lambda x: F.greatest(F.lit(32), (F.bround(F.floor(x * down) / 32, 0) * 32).cast("int"))
    return F.struct(snap(w).alias("width"), snap(h).alias("height"))


def extent_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("float").alias("x"), top.cast("float").alias("y"), (right - left).cast("float").alias("width"), (bottom - top).cast("float").alias("height"))


def layout_label(i: Column) -> Column:
    """The class's name; the id itself beyond the list."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LAYOUT_LABELS]), i), i.cast("string"))


def proposals(scores: Column, k: int = 300) -> Column:
    """Indices of the k proposals with the highest best class score, ties by index. scores: array of arrays."""
    best = F.transform(scores, lambda s, i: F.struct((-F.array_max(s)).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(best), 1, k), lambda x: x["i"])


def layout_candidates(logits: Column, boxes: Column, orders: Column, width: Column, height: Column, least: float = 0.5, most: int = 300) -> Column:
    """Detections struct(score, label, left, top, right, bottom, order) of one image, best first, at most ``most``.

    logits: for each proposal, of each class; boxes: centre and size as parts of the image. A proposal may give
    several labels.
    """
    score = lambda x: (1 / (1 + F.exp(-x.cast("double")))).cast("float")
    every = F.flatten(F.transform(logits, lambda own, p: F.transform(own, lambda x, c: F.struct((-score(x)).alias("s"), p.alias("p"), c.alias("c")))))
    some = F.slice(F.array_sort(F.filter(every, lambda x: -x["s"] >= least)), 1, most)

    def detection(x: Column) -> Column:
        b = F.get(boxes, x["p"])
        cx, cy, w, h = b[0] * width, b[1] * height, b[2] * width, b[3] * height
        held = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), hi.cast("double")).cast("float")
        return F.struct((-x["s"]).alias("score"), layout_label(x["c"]).alias("label"), held(cx - w * 0.5, width).alias("left"), held(cy - h * 0.5, height).alias("top"), held(cx + w * 0.5, width).alias("right"), held(cy + h * 0.5, height).alias("bottom"), F.get(orders, x["p"]).cast("bigint").alias("order"))

    return F.transform(some, detection)


def in_reading_order(detections: Column) -> Column:
    """By order, then top, left, bottom, right, label and score."""
    names = ("order", "top", "left", "bottom", "right", "label", "score")
    return F.array_sort(F.transform(detections, lambda d: F.struct(*[d[n].alias(n) for n in names])))


def ctc_text(indices: Column, scores: Column, dictionary: Column) -> Column:
    """struct(text, confidence): best classes of the steps without blanks (0) and repeats; the mean of their scores, or 0."""
    new = lambda x, i: (x != 0) & ((i == 0) | (x != F.get(indices, i - 1))) & (x <= F.size(dictionary))
    steps = F.filter(F.transform(indices, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
    text = F.array_join(F.transform(steps, lambda i: F.get(dictionary, F.get(indices, i) - 1)), "")
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.get(scores, i).cast("double"))
    return F.struct(text.alias("text"), F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(F.lit(0.0)).cast("float").alias("confidence"))


def ctc_best(logits: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each step and its score; the axis of ``classes`` entries is that of the classes, the last one if both are."""
    x = logits if logits.shape[1] == classes else logits.T
    return x.argmax(axis=1), x.max(axis=1)


def components(scores: np.ndarray, least: float) -> list[tuple[int, int, int, int, int, float]]:
    """(left, top, right, bottom, pixels, mean score) of the 4-connected areas of at least ``least``, ends exclusive, by their first pixel.

    Runs of each row are joined with the runs they touch in the row above.
    """
    h, w = scores.shape
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    runs, above = [], []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (scores[y] >= least).astype(np.int8), [0]])))
        here, k = [], 0
        for a, b in edge.reshape(-1, 2).tolist():
            i = len(root)
            root.append(i)
            runs.append((y, a, b))
            while k < len(above) and above[k][1] <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b:
                p, q = find(above[j][2]), find(i)
                root[max(p, q)] = min(p, q)
                j += 1
            here.append((a, b, i))
        above = here
    out: dict[int, list] = {}
    for i, (y, a, b) in enumerate(runs):
        c = out.setdefault(find(i), [a, y, b, y + 1, 0, 0.0])
        c[0], c[2], c[3] = min(c[0], a), max(c[2], b), y + 1
        c[4] += b - a
        c[5] += float(scores[y, a:b].sum(dtype=np.float64))
    return [(*c[:5], c[5] / c[4]) for _, c in sorted(out.items())]


def text_boxes(scores: np.ndarray, width: int, height: int, least: float = 0.2, least_mean: float = 0.4, ratio: float = 1.4, most: int = 3000) -> np.ndarray:
    """Text boxes (left, top, right, bottom) of a probability map, scaled to the image, in reading order."""
    h, w = scores.shape
    sx, sy, found = np.float32(width) / np.float32(w), np.float32(height) / np.float32(h), []
    area = int(np.ceil(np.float32(h * w) * np.float32(0.00002)))
    for l, t, r, b, n, mean in components(scores, least):  # noqa: E741
        if mean < least_mean or n < area or r - l < 3 or b - t < 3:
            continue
        by = np.float32(n) * np.float32(ratio) / np.float32(2 * (r - l + b - t))
        box = [np.clip(np.float32(l) - by, 0, w) * sx, np.clip(np.float32(t) - by, 0, h) * sy, np.clip(np.float32(r) + by, 0, w) * sx, np.clip(np.float32(b) + by, 0, h) * sy]
        if box[2] > box[0] and box[3] > box[1]:
            found.append(box)
            if len(found) >= most:
                break
    boxes = np.array(found, np.float32).reshape(-1, 4)
    return boxes[reading_order(boxes)]


def reading_order(boxes: np.ndarray, row: float = 10.0) -> list[int]:
    """Indices of boxes by top, left, bottom, right; then each moves left past those of its row (tops within ``row``)."""
    order = np.lexsort((boxes[:, 2], boxes[:, 3], boxes[:, 0], boxes[:, 1])).tolist()
    for i in range(1, len(order)):
        j = i
        while j and abs(boxes[order[j], 1] - boxes[order[j - 1], 1]) < row and boxes[order[j], 0] < boxes[order[j - 1], 0]:
            order[j - 1], order[j] = order[j], order[j - 1]
            j -= 1
    return order


def overlaps(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """IoU of a box with each of boxes."""
    span = np.maximum(0, np.minimum(box[2:], boxes[:, 2:]) - np.maximum(box[:2], boxes[:, :2]))
    common = span[:, 0] * span[:, 1]
    area = lambda b: np.prod(np.maximum(0, b[..., 2:] - b[..., :2]), axis=-1)
    union = area(box) + area(boxes) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def suppressed(boxes: np.ndarray, most: float | None) -> list[int]:
    """Indices of boxes, best first, that overlap no kept one by more than ``most``; all without a limit."""
    kept: list[int] = []
    for i in range(len(boxes)):
        if most is None or not kept or not (overlaps(boxes[i], boxes[kept]) > most).any():
            kept.append(i)
    return kept


def order_ranks(features: np.ndarray) -> np.ndarray:
    """Reading rank of each proposal from its features: halves for leaving and entering edges, followed greedily."""
    n, half = len(features), features.shape[1] // 2
    if features.shape[1] % 2:
        raise ValueError("an even number of features is needed")
    edge = features[:, :half].astype(np.float32) @ features[:, half:].astype(np.float32).T
    inner = edge * (1 - np.eye(n, dtype=np.float32))
    ranks = np.full(n, n)
    if not n:
        return ranks
    at = int(np.argmin(inner.sum(axis=0) - inner.sum(axis=1)))
    open_ = np.ones(n, bool)
    for rank in range(n):
        ranks[at], open_[at] = rank, False
        if not open_.any():
            break
        at = int(np.argmax(np.where(open_, edge[at], -np.inf)))
        if not open_[at]:
            at = int(np.flatnonzero(open_)[0])
    return ranks


def matched(left: np.ndarray, right: np.ndarray, labels: tuple | None = None) -> list[tuple[int, int, float]]:
    """(i, j, IoU): each left box takes the right box that overlaps it most and isn't taken, the first among equals."""
    free, out = np.ones(len(right), bool), []
    for i, b in enumerate(left):
        fits = free & (np.array([x == labels[0][i] for x in labels[1]]) if labels else True)
        if fits.any():
            score = np.where(fits, overlaps(b, right), -1.0)
            j = int(np.argmax(score))
            free[j] = False
            out.append((i, j, float(score[j])))
    return out


def anchors(sizes: list[tuple[int, int]], grid: float = 0.05, edge: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (n, 4) in logit space and their mask for levels (height, width); invalid ones are infinite."""
    out = []
    for level, (h, w) in enumerate(sizes):
        y, x = np.meshgrid((np.arange(h, dtype=np.float32) + np.float32(0.5)) / np.float32(h), (np.arange(w, dtype=np.float32) + np.float32(0.5)) / np.float32(w), indexing="ij")
        side = np.full(h * w, np.float32(grid) * np.float32(2.0**level), np.float32)
        out.append(np.stack([x.ravel(), y.ravel(), side, side], axis=1))
    a = np.concatenate(out) if out else np.zeros((0, 4), np.float32)
    good = ((a > np.float32(edge)) & (a < np.float32(1) - np.float32(edge))).all(axis=1)
    safe = np.where(good[:, None], a, np.float32(0.5))
    return np.where(good[:, None], np.log(safe / (1 - safe)), np.float32(np.inf)).astype(np.float32), good


def position_table(height: int, width: int, features: int = 64, temperature: float = 10_000.0) -> np.ndarray:
    """(height * width, 4 * features): sine and cosine of the row, then of the column."""
    omega = np.float32(1) / np.float32(temperature) ** (np.arange(features, dtype=np.float32) / np.float32(features))
    y, x = (v.ravel()[:, None].astype(np.float32) * omega for v in np.indices((height, width)))
    return np.concatenate([np.sin(y), np.cos(y), np.sin(x), np.cos(x)], axis=1)


def character_dictionary(lines: str) -> list[str]:
    """The recogniser's characters from a model's YAML file (PostProcess: character_dict:), and a space at the end."""

    def scalar(v: str) -> str:
        if len(v) > 1 and v[0] == v[-1] == '"':
            return v[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if len(v) > 1 and v[0] == v[-1] == "'":
            return v[1:-1].replace("''", "'")
        return v.split(" #", 1)[0]

    section, depth, found, inside = None, None, [], False
    for line in lines.split("\n"):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if inside:
            if not body.startswith("-"):
                if indent <= depth:
                    break
                continue
            found.append(scalar(body[1:].strip()))
        elif section is not None and indent <= section:
            section = indent if body == "PostProcess:" else None
        elif section is None:
            section = indent if body == "PostProcess:" else None
        elif body.startswith("character_dict:"):
            rest = body.removeprefix("character_dict:").strip()
            if rest:
                if not (rest.startswith("[") and rest.endswith("]")):
                    raise ValueError("unsupported inline character_dict")
                found = [scalar(v.strip()) for v in rest[1:-1].split(",")]
                break
            inside, depth = True, indent
    if not found:
        raise ValueError("no PostProcess.character_dict")
    return [*found, " "]
