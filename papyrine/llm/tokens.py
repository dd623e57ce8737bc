"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library.

The library is asked once for a pre-token that a bounded cache doesn't hold; texts are cut into pre-tokens with
numpy where every character is under U+0250, by classes that are read off the library's own pre-tokenizer. Any
other text, tokenizer or text with an added token's string goes through the library as a whole. Ids are the same.
The cache compares a pre-token's own bytes, never a hash of them, and has a fixed size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textvec as T

LIMIT = 0x250
#: The cache: places, bytes of a pre-token and ids that an entry holds. About 40 bytes a place with 16-bit ids.
PLACES, MOST_BYTES, MOST_IDS = 1 << 20, 16, 8
#: Longer pre-tokens, each in a dictionary entry.
MOST_LONG = 20_000
_open: dict[str, "Encoder"] = {}
L, N, S, O = 1, 2, 3, 4
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def encoder(spec: str) -> "Encoder":
    """The one of this Python worker; that of another tokenizer file's content is let go."""
    if spec not in _open:
        _open.clear()
        _open[spec] = Encoder(spec)
    return _open[spec]


def vocabulary(spec: str) -> int:
    """One more than the highest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(spec).get_vocab(with_added_tokens=True).values(), default=-1) + 1


class Encoder:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = lib = Tokenizer.from_str(spec)
        pre, model = lib.pre_tokenizer, lib.model
        self.plain = lib.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and isinstance(model, models.BPE) and not model.dropout
        added = lib.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        line = lib.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.plain and len(line) == 1 else None
        if self.plain:
            cuts = lambda s: len(pre.pre_tokenize_str(s))
            self.kind = np.array([0] + [L if cuts(f"a{chr(c)}") == 1 and cuts(f"{chr(c)}a") == 1 else N if cuts(f"1{chr(c)}") == 1 else O if cuts(f"!{chr(c)}") == 1 else S for c in range(1, LIMIT)], np.uint8)
            self.kind[0] = O
            self.kind[0x20] = S
        kind = np.uint16 if max([lib.get_vocab_size(), *added], default=0) < 1 << 16 else np.uint32
        self.low, self.high = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.size, self.n, self.ids = np.zeros(PLACES, np.uint8), np.zeros(PLACES, np.uint8), np.zeros((PLACES, MOST_IDS), kind)
        self.long: dict[bytes, np.ndarray] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def asked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pre-tokens, one after the other, and their numbers.

        Pre-tokens are asked for in one text, parted by line breaks, where that parts their ids too.
        """
        ids, many = [], []
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo : lo + 4096]
            text = b"\n".join(some)
            if self.line is not None and text.count(b"\n") == len(some) - 1:
                x = np.array(self.lib.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(x == self.line)
                n = np.diff(cuts, prepend=-1, append=len(x)) - 1
                if len(n) == len(some) and (n > 0).all():
                    ids.append(x[x != self.line])
                    many.append(n)
                    continue
            each = [self.whole(p.decode()) for p in some]
            ids += each
            many.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *many])

    def pieces(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pre-tokens start, for documents at ``off`` of the characters ``cp``."""
        kind = self.kind[cp]
        space = kind == S
        begin = np.zeros(len(cp), bool)
        begin[off[:-1][off[:-1] < off[1:]]] = True
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        before[begin] = 0
        start = begin | (space & (before != S)) | (~space & (kind != before) & ~np.concatenate([[False], cp[:-1] == 0x20]))
        start[:-1] |= space[:-1] & ~space[1:] & ~begin[1:]
        for i in np.flatnonzero((cp == 39) & start):  # 's 't 're 've 'm 'll 'd, only where a pre-token begins with the mark
            end = int(off[np.searchsorted(off, i, "right")])
            tail = "".join(map(chr, cp[i + 1 : min(i + 3, end)]))
            n = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if n:
                start[i + 1 : i + 1 + n] = False
                if i + 1 + n < end:
                    start[i + 1 + n] = True
        return np.flatnonzero(start)

    def simple(self, raw: np.ndarray, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents at ``off`` of the characters ``cp`` of the bytes ``raw``, and each one's range in them."""
        chars = self.pieces(cp, off)
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        st = chars if len(cp) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)[chars]
        size = np.diff(st, append=len(raw))
        padded = np.concatenate([raw, np.zeros(MOST_BYTES, np.uint8)])
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low, high = eight[st] & _KEEP[np.minimum(size, 8)], eight[np.minimum(st + 8, len(raw) + 8)] & _KEEP[np.clip(size - 8, 0, 8)]
        h = T.mix(low ^ T.mix(high + T._C[5]) ^ size.astype(np.uint64))
        first, second = (h & T.U(PLACES - 1)).astype(np.int64), (h >> T.U(65 - PLACES.bit_length())).astype(np.int64)
        holds = lambda at, i: (self.size[at] == size[i]) & (self.low[at] == low[i]) & (self.high[at] == high[i])
        at, lost = first, np.flatnonzero(~holds(first, slice(None)))
        at[lost] = second[lost]
        lost = lost[~holds(at[lost], lost)]
        n, ids = self.n[at].astype(np.int64), self.ids[at]
        wide = self.learn(raw, st, size, low, high, h, lost, n, ids) if len(lost) else []
        for i, x in wide:
            n[i] = len(x)
        ends = np.cumsum(n)
        out = np.zeros(ends[-1], np.uint32)
        short = np.ones(len(n), bool)
        short[[i for i, _ in wide]] = False
        if short.all():
            out[:] = ids[np.arange(MOST_IDS) < n[:, None]]
        else:
            m = n[short]
            out[np.repeat((ends - n)[short] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = ids[short][np.arange(MOST_IDS) < m[:, None]]
        for i, x in wide:
            out[ends[i] - len(x) : ends[i]] = x
        return out, np.concatenate([[0], ends])[np.searchsorted(chars, off)]

    def learn(self, raw: np.ndarray, st: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, lost: np.ndarray, n: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Fills n and ids of the pre-tokens that the cache doesn't hold, and the cache; returns (place, ids) of those too long for it."""
        wide, short = [], lost[size[lost] <= MOST_BYTES]
        for i in lost[size[lost] > MOST_BYTES]:
            p = raw[st[i] : st[i] + size[i]].tobytes()
            if p not in self.long:
                if len(self.long) >= MOST_LONG:
                    self.long.clear()
                self.long[p] = self.whole(p.decode())
            wide.append((i, self.long[p]))
        _, where, back = np.unique(h[short], return_index=True, return_inverse=True)
        own = short[where]
        if not ((low[short] == low[own][back]) & (high[short] == high[own][back]) & (size[short] == size[own][back])).all():
            own, back = short, np.arange(len(short))  # two of one hash: each for itself
        text = raw.tobytes()
        pieces = [text[a : a + m] for a, m in zip(st[own].tolist(), size[own].tolist(), strict=True)]
        alone = np.array([p.isspace() or b"\n" in p or not p.isascii() and p.decode().isspace() for p in pieces], bool)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        flat, some = self.asked([pieces[i] for i in order[: len(order) - alone.sum()]])
        last = [self.whole(p.decode()) for p, x in zip(pieces, alone, strict=True) if x]
        flat, some = np.concatenate([flat, *last]), np.concatenate([some, np.fromiter(map(len, last), np.int64, len(last))])
        begin, many = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        begin[order], many[order] = np.cumsum(some) - some, some
        fits = many <= MOST_IDS
        table = np.zeros((len(own), MOST_IDS), self.ids.dtype)
        inside = fits[:, None] & (np.arange(MOST_IDS) < many[:, None])
        table[inside] = flat[(begin[:, None] + np.arange(MOST_IDS))[inside]]
        n[short], ids[short] = many[back], table[back]
        wide += [(i, flat[begin[k] : begin[k] + many[k]]) for i, k in zip(short.tolist(), back.tolist(), strict=True) if not fits[k]] if not fits.all() else []
        new, row = own[fits], np.flatnonzero(fits)
        first, second = (h[new] & T.U(PLACES - 1)).astype(np.int64), (h[new] >> T.U(65 - PLACES.bit_length())).astype(np.int64)
        to = np.where(self.size[first] == 0, first, second)
        _, last = np.unique(to[::-1], return_index=True)
        pick = len(to) - 1 - last
        to, new, row = to[pick], new[pick], row[pick]
        self.low[to], self.high[to], self.size[to], self.n[to], self.ids[to] = low[new], high[new], size[new], many[row], table[row]
        return wide

    def encode(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row; null counts as empty."""
        data, off = T.buffers(col)
        for a, b in T.slices(off):
            raw = data[off[a] : off[b]]
            try:
                text = raw.tobytes().decode()
            except UnicodeDecodeError:
                for i in range(a, b):
                    yield self.whole(data[off[i] : off[i + 1]].tobytes().decode(errors="replace"))
                continue
            odd = np.zeros(b - a, bool)
            if not self.plain:
                odd[:] = True
            else:
                lead = np.flatnonzero(raw >= 0xC9)  # U+0240 and on; what is under the limit of these is looked at below
                high = lead[(raw[lead] > 0xC9) | (raw[np.minimum(lead + 1, len(raw) - 1)] >= 0x90)]
                odd[np.searchsorted(off[a:b] - off[a], high, "right") - 1] = True
                for t in (x.encode() for x in self.added if x in text):
                    i = raw.tobytes().find(t)
                    while i >= 0:
                        odd[np.searchsorted(off[a:b] - off[a], i, "right") - 1] = True
                        i = raw.tobytes().find(t, i + 1)
            if not odd.any():
                cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                ids, io = self.simple(raw, cp, ends[off[a : b + 1] - off[a]])
                for i in range(b - a):
                    yield ids[io[i] : io[i + 1]]
                continue
            for i in range(a, b):
                own = data[off[i] : off[i + 1]]
                x = own.tobytes().decode()
                if odd[i - a]:
                    yield self.whole(x)
                else:
                    yield self.simple(own, np.frombuffer(x.encode("utf-32-le"), np.uint32), np.array([0, len(x)]))[0]
