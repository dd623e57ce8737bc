"""Transformer encoders in numpy: weights from safetensors files under their published names, forward passes, a score head."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from .vectors import relative_buckets

_KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "U8": "u1"}
#: What is added to the attention to padding.
MASKED = np.float32(-1e4)


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors by name, floating ones as 32 bits. ValueError for damaged files and other types."""
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(bytes(data[:8]), "little")
    if n > len(data) - 8:
        raise ValueError(f"{path}: damaged header")
    out = {}
    for name, x in json.loads(bytes(data[8 : 8 + n])).items():
        if name == "__metadata__":
            continue
        if x["dtype"] not in _KINDS:
            raise ValueError(f"{path}: tensors of type {x['dtype']} aren't read")
        lo, hi = x["data_offsets"]
        own = np.frombuffer(bytes(data[8 + n + lo : 8 + n + hi]), _KINDS[x["dtype"]]).reshape(x["shape"])
        if x["dtype"] == "BF16":
            own = (own.astype(np.uint32) << 16).view(np.float32)
        out[name] = own.astype(np.float32) if own.dtype.kind == "f" else own
    return out


def renamed(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights without the prefix of the encoder's kind, with the present names of normalisation weights."""
    out = {}
    for name, x in weights.items():
        for prefix in ("bert.", "roberta.", "mpnet.", "model."):
            name = name.removeprefix(prefix)
        out[name.replace("LayerNorm.gamma", "LayerNorm.weight").replace("LayerNorm.beta", "LayerNorm.bias")] = x
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution at x; the error function by a published polynomial, within 1.5e-7."""
    z = np.abs(x) / np.float32(np.sqrt(2))
    t = 1 / (1 + np.float32(0.3275911) * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = np.sign(x) * (1 - poly * np.exp(-z * z))
    return (x * (1 + erf) / 2).astype(x.dtype)


@dataclass
class Encoder:
    """An encoder of kind bert, roberta or mpnet with its weights and the sizes of its configuration."""

    kind: str
    weights: dict[str, np.ndarray]
    layers: int
    heads: int
    epsilon: float
    pad: int

    @staticmethod
    def of(config: dict, weights: dict[str, np.ndarray]) -> Encoder:
        """From the parsed config.json and the weights; ValueError where a tensor is missing or an encoder unknown."""
        kind = {"bert": "bert", "xlm-roberta": "roberta", "roberta": "roberta", "mpnet": "mpnet"}.get(config.get("model_type", ""))
        if kind is None or config.get("hidden_act", "gelu") != "gelu":
            raise ValueError(f"no encoder for {config.get('model_type')} with {config.get('hidden_act')}")
        made = Encoder(kind, renamed(weights), config["num_hidden_layers"], config["num_attention_heads"], config.get("layer_norm_eps", 1e-12), config.get("pad_token_id") or 0)
        size = config["hidden_size"]
        needed = ["embeddings.word_embeddings", "embeddings.position_embeddings", "embeddings.LayerNorm"]
        needed += ["embeddings.token_type_embeddings"] if kind != "mpnet" else ["encoder.relative_attention_bias"]
        needed += [f"encoder.layer.{i}.{part}" for i in range(made.layers) for part in [*made.attention, *made.after]]
        lost = [n for n in needed if f"{n}.weight" not in made.weights]
        if lost:
            raise ValueError(f"weights are missing: {lost[:3]}")
        if made.weights["embeddings.word_embeddings.weight"].shape[1] != size or size % made.heads:
            raise ValueError("weights and configuration differ in size")
        return made

    @property
    def attention(self) -> tuple[str, ...]:
        """Names of the query, key, value and output projections."""
        if self.kind == "mpnet":
            return tuple(f"attention.attn.{x}" for x in "qkvo")
        return ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense")

    @property
    def after(self) -> tuple[str, ...]:
        first = "attention.LayerNorm" if self.kind == "mpnet" else "attention.output.LayerNorm"
        return (first, "intermediate.dense", "output.dense", "output.LayerNorm")

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T + self.weights[f"{name}.bias"]

    def _normal(self, x: np.ndarray, name: str) -> np.ndarray:
        off = x - x.mean(axis=-1, keepdims=True)
        return off / np.sqrt((off * off).mean(axis=-1, keepdims=True) + np.float32(self.epsilon)) * self.weights[f"{name}.weight"] + self.weights[f"{name}.bias"]

    def positions(self, mask: np.ndarray) -> np.ndarray:
        n = np.arange(mask.shape[1])
        if self.kind == "roberta":
            return np.where(mask != 0, np.cumsum(mask != 0, axis=1) + self.pad, self.pad)
        return np.broadcast_to(n + 2 if self.kind == "mpnet" else n, mask.shape)

    def hidden(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Token states (batch, tokens, size)."""
        w = self.weights
        x = w["embeddings.word_embeddings.weight"][ids] + w["embeddings.position_embeddings.weight"][self.positions(mask)]
        if self.kind != "mpnet":
            x = x + w["embeddings.token_type_embeddings.weight"][0]
        x = self._normal(x, "embeddings.LayerNorm")
        batch, n, size = x.shape
        bias = np.where(mask[:, None, None, :] == 0, MASKED, np.float32(0))
        if self.kind == "mpnet":
            table = w["encoder.relative_attention_bias.weight"]
            bias = bias + table[relative_buckets(n, len(table))].transpose(2, 0, 1)[None]
        split = lambda v: v.reshape(batch, n, self.heads, -1).transpose(0, 2, 1, 3)
        for i in range(self.layers):
            at = f"encoder.layer.{i}."
            q, k, v = (split(self._linear(x, at + p)) for p in self.attention[:3])
            scores = q @ k.transpose(0, 1, 3, 2) / np.float32(np.sqrt(size / self.heads)) + bias
            scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
            mixed = (scores / scores.sum(axis=-1, keepdims=True)) @ v
            x = self._normal(x + self._linear(mixed.transpose(0, 2, 1, 3).reshape(batch, n, size), at + self.attention[3]), at + self.after[0])
            x = self._normal(x + self._linear(gelu(self._linear(x, at + self.after[1])), at + self.after[2]), at + self.after[3])
        return x

    def score(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One number for each row, from the first token's state."""
        first = self.hidden(ids, mask)[:, 0]
        return self._linear(np.tanh(self._linear(first, "classifier.dense")), "classifier.out_proj").reshape(-1)
