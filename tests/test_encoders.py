"""Encoders with small random weights against sums written out, and the choices of models and devices."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers, processors

from papyrine.functions.encoders import Encoder, gelu, read_safetensors
from papyrine.functions.vectors import relative_buckets
from papyrine.operators.embedding import embed
from papyrine.providers import WeightsCrossEncoder, WeightsEncoder, devices, ocr_models, ocr_options, padded, pinned

SIZE, HEADS, LAYERS, WORDS = 8, 2, 2, 12


def weights(kind: str) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(7)
    own: dict[str, tuple] = {"embeddings.word_embeddings.weight": (WORDS, SIZE), "embeddings.position_embeddings.weight": (20, SIZE)}
    if kind == "mpnet":
        own["encoder.relative_attention_bias.weight"] = (32, HEADS)
        parts = [*(f"attention.attn.{x}" for x in "qkvo")]
    else:
        own["embeddings.token_type_embeddings.weight"] = (2, SIZE)
        parts = ["attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"]
    shapes = dict.fromkeys(parts, (SIZE, SIZE)) | {"intermediate.dense": (16, SIZE), "output.dense": (SIZE, 16), "output.LayerNorm": (SIZE,)}
    shapes["attention.LayerNorm" if kind == "mpnet" else "attention.output.LayerNorm"] = (SIZE,)
    dense = {f"encoder.layer.{i}.{p}": s for i in range(LAYERS) for p, s in shapes.items()} | {"embeddings.LayerNorm": (SIZE,)}
    dense |= {"classifier.dense": (SIZE, SIZE), "classifier.out_proj": (1, SIZE)}
    for p, s in dense.items():
        own |= {f"{p}.weight": s, f"{p}.bias": s[:1]}
    return {k: draw.normal(size=s).astype(np.float32) for k, s in own.items()}


def config(kind: str) -> dict:
    return {"model_type": {"roberta": "xlm-roberta"}.get(kind, kind), "hidden_size": SIZE, "num_hidden_layers": LAYERS, "num_attention_heads": HEADS, "layer_norm_eps": 1e-5, "pad_token_id": 1 if kind == "roberta" else 0, "max_position_embeddings": 20, "hidden_act": "gelu"}


def by_hand(kind: str, w: dict, ids: list[int]) -> list[list[float]]:
    """Token states of one row without padding, number by number."""
    first = {"bert": 0, "roberta": 2, "mpnet": 2}[kind]
    w = {k: v.astype(float).tolist() for k, v in w.items()}

    def linear(x: list, name: str) -> list:
        return [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]

    def normal(x: list, name: str) -> list:
        mean = sum(x) / len(x)
        dev = math.sqrt(sum((a - mean) ** 2 for a in x) / len(x) + 1e-5)
        return [(a - mean) / dev * b + c for a, b, c in zip(x, w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]

    plus = lambda *v: [sum(a) for a in zip(*v, strict=True)]
    xs = []
    for i, t in enumerate(ids):
        parts = [w["embeddings.word_embeddings.weight"][t], w["embeddings.position_embeddings.weight"][i + first]]
        xs.append(normal(plus(*parts, *([w["embeddings.token_type_embeddings.weight"][0]] if kind != "mpnet" else [])), "embeddings.LayerNorm"))
    names = [f"attention.attn.{x}" for x in "qkvo"] if kind == "mpnet" else ["attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"]
    buckets, d = relative_buckets(len(ids)), SIZE // HEADS
    for layer in range(LAYERS):
        at = f"encoder.layer.{layer}."
        q, k, v = ([linear(x, at + n) for x in xs] for n in names[:3])
        new = []
        for i in range(len(xs)):
            mixed = []
            for h in range(HEADS):
                part = slice(h * d, h * d + d)
                s = [sum(a * b for a, b in zip(q[i][part], k[j][part], strict=True)) / math.sqrt(d) + (w["encoder.relative_attention_bias.weight"][buckets[i, j]][h] if kind == "mpnet" else 0) for j in range(len(xs))]
                e = [math.exp(x) for x in s]
                mixed += [sum(e[j] * v[j][part][c] for j in range(len(xs))) / sum(e) for c in range(d)]
            x = normal(plus(xs[i], linear(mixed, at + names[3])), at + ("attention.LayerNorm" if kind == "mpnet" else "attention.output.LayerNorm"))
            wide = [a * (1 + math.erf(a / math.sqrt(2))) / 2 for a in linear(x, at + "intermediate.dense")]
            new.append(normal(plus(x, linear(wide, at + "output.dense")), at + "output.LayerNorm"))
        xs = new
    return xs


@pytest.mark.parametrize("kind", ["bert", "roberta", "mpnet"])
def test_states_by_hand_and_padding(kind: str) -> None:
    w = weights(kind)
    encoder = Encoder.of(config(kind), {f"{kind}.{k}" if not k.startswith("classifier") else k: v for k, v in w.items()})
    rows = [[2, 5, 7, 3], [2, 11, 3]]
    ids, mask = padded(rows, encoder.pad)
    got = encoder.hidden(ids, mask)
    for i, row in enumerate(rows):
        assert np.abs(got[i, : len(row)] - by_hand(kind, w, row)).max() < 2e-4
    first = np.array(by_hand(kind, w, rows[1])[0])
    score = np.tanh(first @ w["classifier.dense.weight"].T + w["classifier.dense.bias"]) @ w["classifier.out_proj.weight"].T + w["classifier.out_proj.bias"]
    assert encoder.score(ids, mask)[1] == pytest.approx(score[0], abs=1e-3)
    with pytest.raises(ValueError, match="missing"):
        Encoder.of(config(kind), {k: v for k, v in w.items() if "layer.1" not in k})


def saved(folder, kind: str) -> str:
    folder.mkdir()
    head, body = {"__metadata__": {}}, b""
    for k, v in weights(kind).items():
        data = v.tobytes()
        head[k], body = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [len(body), len(body) + len(data)]}, body + data
    raw = json.dumps(head).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + body)
    (folder / "config.json").write_text(json.dumps(config(kind)))
    words = {w: i for i, w in enumerate(["<unk>", "<pad>", "<s>", "</s>", *"abcdefgh"])}
    tok = Tokenizer(models.WordLevel(words, unk_token="<unk>"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.post_processor = processors.TemplateProcessing(single="<s> $A </s>", pair="<s> $A </s> $B </s>", special_tokens=[("<s>", 2), ("</s>", 3)])
    tok.save(str(folder / "tokenizer.json"))
    return str(folder)


def test_providers_over_files(spark, tmp_path) -> None:
    folder = saved(tmp_path / "m", "roberta")
    model = WeightsEncoder(folder, "bge-m3")
    texts = ["a b", "h", None, "c " * 100, ""]
    got = [r.embedding for r in embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1), model).orderBy("i").collect()]
    assert got[2] is None and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got if v)
    first = np.array(by_hand("roberta", weights("roberta"), [2, 4, 5, 3])[0])
    assert np.abs(np.array(got[0]) - first / np.linalg.norm(first)).max() < 1e-4
    a, b = WeightsCrossEncoder(folder).open().scores([("a", "b c"), ("a " * 50, "b")])
    assert a != b and np.isfinite([a, b]).all()


def test_safetensors_kinds_and_gelu(tmp_path) -> None:
    x = np.array([1.5, -2.0, 0.25], np.float32)
    body = (x.view(np.uint32) >> 16).astype("<u2").tobytes() + x.astype("<f2").tobytes()
    head = json.dumps({"b": {"dtype": "BF16", "shape": [3], "data_offsets": [0, 6]}, "h": {"dtype": "F16", "shape": [3, 1], "data_offsets": [6, 12]}}).encode()
    path = tmp_path / "x.safetensors"
    path.write_bytes(struct.pack("<Q", len(head)) + head + body)
    got = read_safetensors(str(path))
    assert (got["b"] == x).all() and (got["h"] == x[:, None]).all()
    path.write_bytes(b"\xff" * 20)
    with pytest.raises(ValueError):
        read_safetensors(str(path))
    z = np.linspace(-6, 6, 99)
    assert np.abs(gelu(z) - [a * (1 + math.erf(a / math.sqrt(2))) / 2 for a in z]).max() < 1e-6


def test_choices(tmp_path) -> None:
    assert devices(["CPUExecutionProvider"]) == ["CPUExecutionProvider"]
    assert devices(["CPUExecutionProvider", "CUDAExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert devices(["CUDAExecutionProvider"], "cpu") == ["CPUExecutionProvider"]
    assert ocr_options() == {"detection_model": "PpOcrV6Tiny", "recognition_model": "PpOcrV6Tiny"}
    assert ocr_options({"detector": "PpOcrV6SmallDet", "recognition_model": "PpOcrV6Medium"}) == {"detection_model": "PpOcrV6Small", "recognition_model": "PpOcrV6Medium"}
    for bad in ({"detection_model": "PpOcrV6SmallRec"}, {"detection_model": "PpOcrV6Tiny", "detector": "PpOcrV6Tiny"}):
        with pytest.raises(ValueError):
            ocr_options(bad)
    got = ocr_models("/m", {"detector": "PpOcrV6Medium"})
    assert got.detector == "/m/detection/medium.onnx" and got.recogniser == "/m/recognition/tiny.onnx" and got.least_mean == 0.45
    base = tmp_path / "models--a--b"
    (base / "snapshots" / "r1").mkdir(parents=True)
    (base / "refs").mkdir()
    (base / "refs" / "main").write_text("r1")
    (base / "snapshots" / "r1" / "w.bin").write_text("x")
    assert pinned(str(tmp_path), "a/b", "w.bin") == pinned(str(tmp_path), "a/b", "w.bin", "r1")
    with pytest.raises(FileNotFoundError):
        pinned(str(tmp_path), "a/b", "w.bin", "r2")
