"""Token ids in shards of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. Its values are cut into blocks of 1,024: the block's minimum is
subtracted, the rest is packed at the width that a percentile of them needs, and what does not fit lies in the
block's exception list (positions and whole values). The shard's header has each document's id and length and
the byte at which each block starts, so any block can be read by itself.

  magic b"PFR1" | u32 documents | u64 values | u32 blocks | u32 last block's values
  i64 doc_id[], u8 doc_id is null (bits), u32 length[] | u64 block start[]
  block: u32 minimum | u8 width | u16 exceptions | packed words u64[16 * width] | u16 position[] | u32 value[]

Shards are rows of a Parquet table in the shared folder, so a lost task's files never count. Documents are in
ascending doc_id order (nulls first, ties by the text's hash); null text counts as empty and still has its end id. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import by_id, give_back, table, written
from lumisift.llm.ids import encoder, groups_of, texts_of

BLOCK, LANES = 1024, 16
BLOCKS_AT_ONCE = 128
PERCENTILE = 0.98
SHARD_IDS = 1 << 20
END_ID = 2


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(groups, 1024) values below 2**width as (groups, 16 * width) words; lane k holds values k, 16 + k, ..."""
    if not width:
        return np.empty((len(v), 0), np.uint64)
    lanes = v.reshape(len(v), 64, LANES).transpose(1, 0, 2).astype(np.uint64)
    out = np.zeros((width, len(v), LANES), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return out.transpose(1, 0, 2).reshape(len(v), LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, LANES).transpose(1, 0, 2)
    out = np.empty((64, len(words), LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = w[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return out.transpose(1, 0, 2).reshape(len(words), BLOCK).astype(np.uint32)


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Each block of uint32 values, BLOCKS_AT_ONCE in a step; the last is filled up with its own first value."""
    step = BLOCK * BLOCKS_AT_ONCE
    return [x for i in range(0, len(values), step) for x in _encode_blocks(values[i : i + step], percentile)]


def _encode_blocks(values: np.ndarray, percentile: float) -> list[bytes]:
    n = -(-len(values) // BLOCK)
    fill = np.full(n * BLOCK, values[(n - 1) * BLOCK], np.uint32)
    fill[: len(values)] = values
    v = fill.reshape(n, BLOCK)
    low = v.min(1)
    rest = v - low[:, None]
    k = min(BLOCK - 1, int(percentile * BLOCK))
    top = np.partition(rest, k, axis=1)[:, k]
    width = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        r = rest[rows]
        over = r > np.uint32((1 << w) - 1)
        packed = _pack(np.where(over, 0, r), w)
        at, pos = np.nonzero(over)
        cut = np.searchsorted(at, np.arange(len(rows) + 1))
        vals = v[rows][at, pos].astype("<u4")
        pos = pos.astype("<u2")
        for i, row in enumerate(rows.tolist()):
            s, e = cut[i], cut[i + 1]
            out[row] = struct.pack("<IBH", int(low[row]), w, e - s) + packed[i].astype("<u8").tobytes() + pos[s:e].tobytes() + vals[s:e].tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The whole blocks that start at these bytes, one after the other."""
    heads = [struct.unpack_from("<IBH", data, s) for s in starts.tolist()]
    out = np.empty((len(starts), BLOCK), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = LANES * w * 8
        words = np.frombuffer(b"".join(data[s + 7 : s + 7 + size] for s in starts[rows].tolist()), "<u8").reshape(len(rows), LANES * w)
        out[rows] = _unpack(words, w) if w else 0
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    for i, (s, (_, w, n)) in enumerate(zip(starts.tolist(), heads, strict=True)):
        if n:
            at = s + 7 + LANES * w * 8
            out[i, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return out.ravel()


def encode_shard(doc_ids: list[int | None], ids: list[bytes], percentile: float = PERCENTILE) -> bytes:
    values = np.frombuffer(b"".join(ids), "<u4").astype(np.uint32)
    blocks = encode_blocks(values, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0, np.int64)
    head = struct.pack("<4sIQII", b"PFR1", len(ids), len(values), len(blocks), len(values) - BLOCK * (len(blocks) - 1) if blocks else 0)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits([d is None for d in doc_ids]).tobytes() + np.array([len(i) // 4 for i in ids], "<u4").tobytes()
    return head + docs + starts.astype("<u8").tobytes() + b"".join(blocks)


def _head(data: bytes) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """Document ids, their lengths, the number of values, and the byte at which each block starts."""
    magic, docs, values, blocks, _ = struct.unpack_from("<4sIQII", data)
    if magic != b"PFR1":
        raise ValueError("not a shard")
    at = 24
    doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
    at += 8 * docs
    null = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at))[:docs]
    at += -(-docs // 8)
    lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64) + at + 8 * blocks
    return [None if n else d for d, n in zip(doc_ids, null, strict=True)], lengths, values, starts


def decode_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all values."""
    doc_ids, lengths, values, starts = _head(data)
    steps = range(0, len(starts), BLOCKS_AT_ONCE)
    blocks = [decode_blocks(data, starts[i : i + BLOCKS_AT_ONCE]) for i in steps]
    return doc_ids, lengths, np.concatenate(blocks)[:values] if blocks else np.empty(0, np.uint32)


def read_document(data: bytes, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row of one document, by the block starts: only the blocks that hold them are decoded."""
    doc_ids, lengths, _, starts = _head(data)
    ends = np.cumsum(lengths)
    out = []
    for i in (i for i, d in enumerate(doc_ids) if d == doc_id):
        s, e = int(ends[i] - lengths[i]), int(ends[i])
        first = s // BLOCK
        out.append(decode_blocks(data, starts[first : -(-e // BLOCK)])[s - first * BLOCK : e - first * BLOCK] if e > s else np.empty(0, np.uint32))
    return out


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The written table (part, seq, before, n_ids, shard): before counts the ids of the part's earlier shards."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = encoder(path).encode, TaskContext.get().partitionId(), 0, 0
        held_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seq, before, size, encode_shard(held_ids, held)), schema, strict=True)], schema=schema)

        for whole in it:
            for b in groups_of(whole, 1):
                for d, x in zip(b.column(0).to_pylist(), encode(texts_of(b.column(1))), strict=True):
                    held_ids.append(d)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= shard_ids:
                        yield flush()
                        seq, before = seq + 1, before + size
                        held_ids, held, size = [], [], 0
        if held:
            yield flush()
        give_back()

    return written(by_id(docs).mapInArrow(run, "part int, seq int, before long, n_ids long, shard binary"), "ids")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row a partition
    first, n = {}, 0
    for p in sorted(totals):
        first[p], n = n, n + totals[p]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, before, shard in zip(*(b.column(c).to_pylist() for c in ("part", "before", "shard")), strict=True):
                doc_ids, lengths, values = decode_shard(shard)
                ends = np.cumsum(lengths)
                data = memoryview(values.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + before + first[part]), pa.array(lengths), pa.array(crc, pa.int64())], schema=schema)

    return shards.select("part", "before", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
