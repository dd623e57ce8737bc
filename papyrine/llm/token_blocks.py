"""Token ids as canonical, length-limited Huffman codes in independent blocks.

A set of files is two Parquet tables, so that any store that Spark writes to can hold it and a lost task's
half-written rows never count: ``codebook`` (one row: the code length of each id) and ``blocks``
(part, seq, before, n_tokens, block; before: the ids of the part's earlier blocks). A block holds whole documents and
can be decoded alone; its bytes are

    b"PTB2", interval u32, documents u64, tokens u64, bytes of code u64,
    doc ids i64[documents], doc id present u8[documents], tokens of each u64[documents],
    bit offset of every interval-th token of each document u64[sum of ceil(tokens / interval)],
    code bits from the highest on; each document begins with a byte

Documents are coded before they are sorted, so that what is shuffled is as small as the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as T
from .scratch import new_path, stored
from .tokens import encoder, vocabulary

HEAD = struct.Struct("<4sIQQQ")
INTERVAL, BLOCK = 64, 1 << 16
BLOCKS = "part int, seq long, before long, n_tokens long, block binary"


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    live = np.flatnonzero(counts)
    if len(live) <= 1:
        out[live] = 1
        return out
    limit = max(limit, int(len(live) - 1).bit_length())
    if limit > 24:
        raise ValueError("more than 2**24 different ids")
    live = live[np.lexsort((live, counts[live]))]
    w = counts[live].astype(np.float64)
    levels, packs = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([w, packs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(w))
        both = both[order]
        packs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    n, bits = 2 * len(live) - 2, np.zeros(len(live), np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:n].sum())
        bits[:k] += 1
        n = 2 * (n - k)
    out[live] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last, code = code, n, code + 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for each window of as many bits as the longest code has."""
    top = max(1, int(lengths.max(initial=0)))
    ids, bits = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    live = np.flatnonzero(lengths)
    order = live[np.lexsort((live, lengths[live]))]
    span = 1 << (top - lengths[order].astype(np.int64))
    ids[: span.sum()], bits[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits, top


def pack(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Code bits of documents of ``sizes`` ids, where each document's bytes end, and each id's bit offset in its document."""
    if not len(ids):
        return b"", np.zeros(len(sizes), np.int64), np.zeros(0, np.int64)
    n = lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    last = np.cumsum(sizes)
    bits = upto[last] - upto[last - sizes]
    ends = np.cumsum((bits + 7) // 8)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    within = upto[:-1] - upto[(last - sizes)[doc]]
    off = within + 8 * (ends - (bits + 7) // 8)[doc]
    word, room = off >> 6, 64 - (off & 63) - n
    c = codes[ids].astype(np.uint64)
    here = np.where(room >= 0, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(ends[-1]) // 8 + 2, np.uint64)
    words[word[first]] = np.add.reduceat(here, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] += c[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(ends[-1])], ends, within


def unpack(bits: bytes, marks: np.ndarray, tokens: np.ndarray, interval: int, table: tuple) -> np.ndarray:
    """The ids of stretches of ``tokens`` ids that begin at the bit offsets; they are decoded side by side."""
    ids, size, top = table
    b = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    w = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    pos, out, most = marks.astype(np.int64), np.zeros((interval, len(marks)), np.uint32), len(w) - 1
    for k in range(interval):
        seen = (w[np.minimum(pos >> 3, most)] >> (32 - (pos & 7) - top).astype(np.uint32)) & np.uint32((1 << top) - 1)
        out[k] = ids[seen]
        pos += size[seen]
    return out.T[np.arange(interval) < tokens[:, None]]


def block_bytes(doc_ids: list, sizes: list[int], widths: list[bytes], coded: list[bytes]) -> bytes:
    """A block of documents: their numbers of ids, bits between checkpoints (u16) and code."""
    starts = 8 * np.concatenate([[0], np.cumsum([len(x) for x in coded])])[:-1]
    marks = [s + np.concatenate([[0], np.cumsum(np.frombuffer(w, "<u2"), dtype=np.int64)]) for s, w, n in zip(starts, widths, sizes, strict=True) if n]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = HEAD.pack(b"PTB2", INTERVAL, len(doc_ids), sum(sizes), sum(map(len, coded)))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(sizes, "<u8").tobytes(), *[m.astype("<u8").tobytes() for m in marks], *coded])


def read_block(block: bytes, table: tuple) -> tuple[list, list[np.ndarray]]:
    """Document ids and each one's token ids."""
    magic, interval, docs, _, size = HEAD.unpack_from(block)
    if magic != b"PTB2":
        raise ValueError("not a token block")
    at = HEAD.size
    parts = []
    for kind, n in (("<i8", lambda: docs), ("u1", lambda: docs), ("<u8", lambda: docs), ("<u8", lambda: int(per.sum()))):
        parts.append(np.frombuffer(block, kind, n(), at))
        at += parts[-1].nbytes
        per = -(-parts[-1].astype(np.int64) // interval)  # checkpoints of each document, once its tokens are read
    sizes = parts[2].astype(np.int64)
    per = -(-sizes // interval)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    ids = unpack(block[at : at + size], parts[3], np.minimum(interval, np.repeat(sizes, per) - interval * place), interval, table)
    return [int(d) if k else None for d, k in zip(parts[0], parts[1], strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """doc_id and the ids of each whole text with the end id, and the ids' kind: u16 where the vocabulary allows it, else u32.

    tokenizer is the driver's path of a file of the tokenizers library; executors get its content.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(content)
    kind = "<u2" if max(vocabulary(content), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(spec.value), np.array([end_id], kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(kind).tobytes() + end for x in e.encode(part.column(1))], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.tidied(encode), "doc_id long, ids binary"), kind


def count_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; as many numbers as the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                x = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(i, 256).to_pylist()), kind))
                if len(x) > len(total):
                    x, total = total, x
                total[: len(x)] += x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    got = tokens.select("ids").mapInArrow(T.tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = got.column("id").to_numpy()
    out = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    out[ids] = got.column("n").to_numpy()
    return out


def write_blocks(tokens: DataFrame, kind: str, path: str, limit: int = 16, block: int = BLOCK) -> None:
    """Writes the files of a (doc_id, ids) table in ascending doc_id order, rows without an id first."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens, kind), limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [np.frombuffer(x.as_py(), kind) for x in part.column(1)]
                sizes = np.array([len(t) for t in texts], np.int64)
                code, ends, within = pack(np.concatenate(texts).astype(np.int64), sizes, codes, lengths)
                begin, first = ends - np.diff(ends, prepend=0), np.cumsum(sizes) - sizes
                widths = [np.diff(within[f : f + n : INTERVAL]).astype("<u2").tobytes() for f, n in zip(first, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(widths, pa.binary()), pa.array([code[b:e] for b, e in zip(begin, ends, strict=True)], pa.binary())], ["doc_id", "n", "widths", "code"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            own = block_bytes(*map(list, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([own], pa.binary())], ["part", "seq", "before", "n_tokens", "block"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += row[1]
                if size >= block:
                    yield made()
                    held, seq, before, size = [], seq + 1, before + size, 0
        if held:
            yield made()

    rows = tokens.select("doc_id", "ids").mapInArrow(T.tidied(encode), "doc_id long, n long, widths binary, code binary")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "code")
    rows.mapInArrow(T.tidied(gather), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian u32) of each document in the files."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row for each task that wrote blocks: so few that they fit in one task and can be sent to all
    base = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    base = stored(base.select("part", "base"), "begin")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = read_block(batch.column(1)[i].as_py(), table)
                n = np.array([len(t) for t in texts], np.int64)
                start = batch.column(0)[i].as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array([t.astype("<u4").tobytes() for t in texts], pa.binary())], ["doc_id", "start", "ids"])

    placed = blocks.join(F.broadcast(base), "part").select((F.col("before") + F.col("base")).alias("begin"), "block")
    return placed.mapInArrow(T.tidied(decode), "doc_id long, start long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents that read_blocks returns."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(T.tidied(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, limit: int = 16, block: int = BLOCK) -> DataFrame:
    """Writes the ids of every whole text of docs (doc_id, text, ...) to files at path; returns what is read back.

    A null text counts as empty: its document is the end id alone. Documents are ordered by doc_id, those
    without one first; rows that repeat an id stay, ordered by their number of ids and their code. Other columns are not read.
    An empty table gives files without blocks. Memory follows one block and the longest text.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    tokens, kind = tokenized(docs, tokenizer, end_id)
    write_blocks(stored(tokens, "tokens", compression="zstd"), kind, path, limit, block)
    return read_blocks(spark, path)
