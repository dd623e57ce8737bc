"""Models behind one interface: a provider is a small frozen value that says how to open a model.

Operators open a provider once for each Python worker and send it batches. Weights are never fetched in a task: paths
are shared folders, or names given to ``SparkContext.addFile``. Providers named StandIn compute something simple and
deterministic for tests; what they return is no model's output.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

_open: dict[Any, Any] = {}


class Provider(Protocol):
    def open(self) -> Any: ...  # noqa: ANN401


def loaded(provider: Provider) -> Any:  # noqa: ANN401
    """The opened model of this worker."""
    if provider not in _open:
        _open[provider] = provider.open()
    return _open[provider]


def asset(path: str) -> str:
    """A local path of a shared file, or of one given to addFile."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    found = SparkFiles.get(os.path.basename(path))
    if not os.path.exists(found):
        raise FileNotFoundError(f"model file {path} is neither shared nor added to the application")
    return found


def pinned(cache: str, repo: str, name: str, revision: str | None = None) -> str:
    """The path of a file in a shared model cache of the usual hub layout, at a revision or at what ``main`` names there.

    Nothing is fetched: a cluster's tasks read what was put into the shared folder.
    """
    base = os.path.join(cache, "models--" + repo.replace("/", "--"))
    if revision is None:
        with open(os.path.join(base, "refs", "main"), encoding="utf-8") as f:
            revision = f.read().strip()
    path = os.path.join(base, "snapshots", revision, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{name} of {repo} at {revision} isn't in {cache}")
    return path


# Execution providers by preference.
ACCELERATORS = ("CUDAExecutionProvider", "ROCMExecutionProvider", "CoreMLExecutionProvider", "DmlExecutionProvider")


def devices(available: list[str], device: str = "auto") -> list[str]:
    """Execution providers to try: an accelerator where one answers, then the CPU; ``cpu`` asks for it alone."""
    if device not in ("auto", "cpu"):
        raise ValueError(f"unknown device {device}")
    return [x for x in ACCELERATORS if device == "auto" and x in available][:1] + ["CPUExecutionProvider"]


def session(path: str, inputs: dict[str, int] | None = None, device: str = "auto"):  # noqa: ANN201
    """An ONNX Runtime session of one thread; inputs: names and ranks that the model must have."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    s = ort.InferenceSession(asset(path), options, providers=devices(ort.get_available_providers(), device))
    have = {i.name: len(i.shape) for i in s.get_inputs()}
    for name, rank in (inputs or {}).items():
        if have.get(name, rank) != rank:
            raise ValueError(f"{path}: input {name} has rank {have[name]}, not {rank}")
    return s


@dataclass(frozen=True)
class Classifier:
    """An ONNX file type classifier over byte features; thresholds and overwrite are pairs of a label and a value."""

    path: str
    labels: tuple[str, ...]
    thresholds_of: tuple[tuple[str, float], ...] = ()
    overwrite_of: tuple[tuple[str, str], ...] = ()
    begin: int = 1024
    end: int = 1024
    padding: int = 256
    least: int = 8

    @property
    def thresholds(self) -> dict[str, float]:
        return dict(self.thresholds_of)

    @property
    def overwrite(self) -> dict[str, str]:
        return dict(self.overwrite_of)

    def open(self) -> Any:  # noqa: ANN401
        return _OnnxClassifier(self)


class _OnnxClassifier:
    def __init__(self, spec: Classifier):
        self.session = session(spec.path, device="cpu")

    def scores(self, features: list) -> np.ndarray:
        name = self.session.get_inputs()[0].name
        return self.session.run(None, {name: np.stack(features).astype(np.int32)})[0]


@dataclass(frozen=True)
class StandInClassifier(Classifier):
    """Says the label at the sum of the features modulo the number of labels, with certainty 0.9."""

    path: str = ""
    labels: tuple[str, ...] = ("html", "xml", "mp4", "txt")

    def open(self) -> Any:  # noqa: ANN401
        return self

    def scores(self, features: list) -> np.ndarray:
        out = np.full((len(features), len(self.labels)), 0.1 / max(1, len(self.labels) - 1), np.float32)
        out[np.arange(len(features)), [int(np.sum(f)) % len(self.labels) for f in features]] = 0.9
        return out


# Known text encoders, their vectors' size, pooling and token limits.
ENCODERS = {
    "all-MiniLM-L6-v2": (384, "mean", 256),
    "all-MiniLM-L12-v2": (384, "mean", 128),
    "bge-small-en-v1.5": (384, "cls", 512),
    "bge-base-en-v1.5": (768, "cls", 512),
    "bge-large-en-v1.5": (1024, "cls", 512),
    "all-mpnet-base-v2": (768, "mean", 384),
    "bge-m3": (1024, "cls", 8192),
}
DEFAULT_ENCODER = "all-MiniLM-L12-v2"


def padded(ids: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their mask, padded to the longest of the batch."""
    n = max(map(len, ids), default=0)
    out, mask = np.full((len(ids), n), pad, np.int64), np.zeros((len(ids), n), np.int64)
    for i, x in enumerate(ids):
        out[i, : len(x)], mask[i, : len(x)] = x, 1
    return out, mask


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Unit vectors of token states (batch, tokens, size)."""
    if how == "cls":
        v = hidden[:, 0]
    else:
        m = mask[..., None].astype(np.float32)
        v = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), np.float32(1e-9))
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), np.float32(1e-12))


class _Tokens:
    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(asset(path))
        self.lib.enable_truncation(limit)
        self.lib.no_padding()

    def __call__(self, texts: list) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch(texts)]


@dataclass(frozen=True)
class TextEncoder:
    """An exported encoder (model.onnx, tokenizer.json) in a folder; model is a key of ENCODERS."""

    folder: str
    model: str = DEFAULT_ENCODER
    pad: int = 0

    def open(self) -> Any:  # noqa: ANN401
        return _OnnxEncoder(self)


class _OnnxEncoder:
    def __init__(self, spec: TextEncoder):
        self.spec, (self.size, self.how, limit) = spec, ENCODERS[spec.model]
        self.session = session(os.path.join(spec.folder, "model.onnx"), {"input_ids": 2, "attention_mask": 2})
        self.tokens = _Tokens(os.path.join(spec.folder, "tokenizer.json"), limit)

    def vectors(self, texts: list[str]) -> np.ndarray:
        ids, mask = padded(self.tokens(texts), self.spec.pad)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = self.session.run(None, {i.name: feed[i.name] for i in self.session.get_inputs()})[0]
        return pooled(hidden, mask, self.how)


@dataclass(frozen=True)
class CrossEncoder:
    """An exported pair scorer (model.onnx, tokenizer.json) in a folder."""

    folder: str
    limit: int = 512
    pad: int = 1

    def open(self) -> Any:  # noqa: ANN401
        return _OnnxPairs(self)


class _OnnxPairs:
    def __init__(self, spec: CrossEncoder):
        self.spec = spec
        self.session = session(os.path.join(spec.folder, "model.onnx"), {"input_ids": 2, "attention_mask": 2})
        self.tokens = _Tokens(os.path.join(spec.folder, "tokenizer.json"), spec.limit - 2)

    def scores(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        ids, mask = padded(self.tokens(pairs), self.spec.pad)
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return self.session.run(None, {i.name: feed[i.name] for i in self.session.get_inputs()})[0].reshape(-1)


def _encoder(folder: str):  # noqa: ANN202
    import json

    from .functions.encoders import Encoder, read_safetensors

    with open(asset(os.path.join(folder, "config.json")), encoding="utf-8") as f:
        config = json.load(f)
    return Encoder.of(config, read_safetensors(asset(os.path.join(folder, "model.safetensors")))), config


@dataclass(frozen=True)
class WeightsEncoder:
    """A published encoder (config.json, model.safetensors, tokenizer.json) in a folder, run in numpy; model is a key of ENCODERS."""

    folder: str
    model: str = DEFAULT_ENCODER

    def open(self) -> Any:  # noqa: ANN401
        return _NumpyText(self.folder, *ENCODERS[self.model][1:])


@dataclass(frozen=True)
class WeightsCrossEncoder:
    """A published pair scorer (config.json, model.safetensors, tokenizer.json) in a folder, run in numpy."""

    folder: str

    def open(self) -> Any:  # noqa: ANN401
        return _NumpyText(self.folder)


class _NumpyText:
    """Token ids beyond the encoder's positions are cut off, as the model has no state for them."""

    def __init__(self, folder: str, how: str = "cls", limit: int | None = None):
        self.encoder, config = _encoder(folder)
        self.how, most = how, config["max_position_embeddings"] - (0 if self.encoder.kind == "bert" else 2)
        self.pad = self.encoder.pad if self.encoder.kind == "roberta" else 0
        self.tokens = _Tokens(os.path.join(folder, "tokenizer.json"), min(most, limit or most))

    def vectors(self, texts: list[str]) -> np.ndarray:
        ids, mask = padded(self.tokens(texts), self.pad)
        return pooled(self.encoder.hidden(ids, mask), mask, self.how)

    def scores(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return self.encoder.score(*padded(self.tokens(pairs), self.pad))


@dataclass(frozen=True)
class StandInText:
    """Hashed word counts as unit vectors; pairs score by the cosine of theirs."""

    size: int = 16

    def open(self) -> Any:  # noqa: ANN401
        return self

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.size] += 1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), np.float32(1e-12))

    def scores(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return (self.vectors([a for a, _ in pairs]) * self.vectors([b for _, b in pairs])).sum(axis=1)


# Names of detectors and recognisers, which may be paired freely, and the tier of each.
OCR_TIERS = {"PpOcrV6Tiny": "tiny", "PpOcrV6Small": "small", "PpOcrV6Medium": "medium"}
# Older names of the options and of the models.
OCR_OPTIONS = {"detection_model": ("detector", "Det"), "recognition_model": ("recognizer", "Rec")}


def ocr_options(options: dict[str, str | None] | None = None) -> dict[str, str]:
    """detection_model and recognition_model by their present names; the tiny ones where none are named."""
    options = dict(options or {})
    options.pop("cache_dir", None)
    out = {}
    for key, (older, ending) in OCR_OPTIONS.items():
        if key in options and older in options:
            raise ValueError(f"{key} is given twice")
        name = options.pop(key, None) or options.pop(older, None) or "PpOcrV6Tiny"
        name = name.removesuffix(ending)
        if name not in OCR_TIERS:
            raise ValueError(f"unknown {key} {name}")
        out[key] = name
    return out


def ocr_models(folder: str, options: dict[str, str | None] | None = None) -> OcrModels:
    """The models of ``ocr_options`` in a shared folder: detection/{tier}.onnx, recognition/{tier}.onnx and .yml."""
    det, rec = (OCR_TIERS[x] for x in ocr_options(options).values())
    at = lambda *x: os.path.join(folder, *x)
    return OcrModels(at("detection", f"{det}.onnx"), at("recognition", f"{rec}.onnx"), at("recognition", f"{rec}.yml"), det, rec)


@dataclass(frozen=True)
class OcrModels:
    """ONNX text detector and recogniser, and the recogniser's YAML file with its characters; tiers may be mixed."""

    detector: str
    recogniser: str
    characters: str
    tier: str = "tiny"
    recogniser_tier: str = "tiny"

    @property
    def least_mean(self) -> float:
        return 0.4 if self.tier == "tiny" else 0.45

    def open(self) -> Any:  # noqa: ANN401
        return _OnnxOcr(self)


class _OnnxOcr:
    def __init__(self, spec: OcrModels):
        from .functions.geometry import character_dictionary

        self.detector, self.recogniser = session(spec.detector), session(spec.recogniser)
        with open(asset(spec.characters), encoding="utf-8") as f:
            self.characters = character_dictionary(f.read())

    def map(self, x: np.ndarray) -> np.ndarray:
        """The probability map (height, width) of an image tensor."""
        return self.detector.run(None, {self.detector.get_inputs()[0].name: x[None]})[0][0, 0]

    def read(self, batch: np.ndarray) -> np.ndarray:
        """Class scores (crops, steps, classes)."""
        return self.recogniser.run(None, {self.recogniser.get_inputs()[0].name: batch})[0]


@dataclass(frozen=True)
class StandInOcr:
    """Dark pixels are text; every crop reads as one ``x`` for each started 100 columns of its tensor."""

    characters: tuple[str, ...] = ("x", " ")
    least_mean: float = 0.4
    tier: str = "stand-in"

    def open(self) -> Any:  # noqa: ANN401
        return self

    def map(self, x: np.ndarray) -> np.ndarray:
        return (x.mean(axis=0) < 0).astype(np.float32)

    def read(self, batch: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), 2 * -(-batch.shape[3] // 100), len(self.characters) + 1), np.float32)
        out[:, ::2, 1], out[:, 1::2, 0] = 0.9, 0.8
        return out


@dataclass(frozen=True)
class LayoutModel:
    """An ONNX layout detector with outputs logits (proposals, classes), boxes (proposals, 4) and order features."""

    path: str
    outputs: tuple[str, str, str] = ("logits", "boxes", "order")
    labels: tuple[str, ...] = field(default=())

    def open(self) -> Any:  # noqa: ANN401
        return _OnnxLayout(self)


class _OnnxLayout:
    def __init__(self, spec: LayoutModel):
        self.session, self.outputs = session(spec.path), list(spec.outputs)

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(v[0] for v in self.session.run(self.outputs, {self.session.get_inputs()[0].name: x[None]}))


@dataclass(frozen=True)
class StandInLayout:
    """Two fixed proposals: a title at the top, text under it."""

    def open(self) -> Any:  # noqa: ANN401
        return self

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = np.full((2, 25), -9.0, np.float32)
        logits[0, 22], logits[1, 6] = 2.0, 3.0
        boxes = np.array([[0.5, 0.6, 0.8, 0.6], [0.5, 0.1, 0.8, 0.1]], np.float32)
        return logits, boxes, np.array([[0.0, 1.0], [1.0, 0.0]], np.float32)
