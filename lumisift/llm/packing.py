"""Order-preserving packing of documents into sequences by dynamic programming.

Documents in ascending doc_id order form one stream of ids. A sequence is a window of at most `width` ids; window
ends are chosen among document ends, sentence ends and, where those lie far apart, a grid of other places. Over
the candidate places p, cost(p) = cut(p) + min over q in [p - width, p) of cost(q) + width - (p - q): the padding
of the window plus a penalty for truncating there. The minimum of cost(q) - ... + q over a sliding window is kept
in a monotone queue, so each place enters and leaves once. Windows whose length is a power of two need no padding
and are tried besides. The stream is solved in stretches of about a million ids, each packed whole.

Null text counts as empty and still has its end id. Repeated rows are packed as often as they occur; null ids come
first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.common import by_id, give_back, table
from lumisift.llm.ids import encoder, groups_of, texts_of

WIDTH = 2048
END_ID = 1
STRETCH = 1 << 20
GRID = 64
SENTENCE_CUT, OTHER_CUT, SHORT_WINDOW = 2.0, 12.0, 16.0
POWERS = (1024,)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ascending(*places: np.ndarray) -> np.ndarray:
    """Each place once, ascending."""
    x = np.sort(np.concatenate(places), kind="stable")
    return x[np.append(True, x[1:] != x[:-1])]


def places(ends: np.ndarray, sentence: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a stream and their penalties: document ends, sentence ends, and a grid in longer gaps."""
    total = int(ends[-1])
    at = _ascending([0], ends, sentence)
    gap = np.diff(at)
    extra = (gap - 1) // grid
    fill = np.repeat(at[:-1], extra) + grid * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    at = _ascending(at, fill)
    cost = np.full(len(at), OTHER_CUT)
    cost[np.searchsorted(at, sentence)] = SENTENCE_CUT
    cost[np.searchsorted(at, ends)] = 0.0
    cost[0] = 0.0
    assert at[-1] == total
    return at, cost


def cuts(at: np.ndarray, penalty: np.ndarray, width: int = WIDTH, powers: tuple[int, ...] = POWERS) -> list[int]:
    """The places, 0 first, at which the cheapest windows end."""
    where, pen = at.tolist(), penalty.tolist()
    index = {p: i for i, p in enumerate(where)}
    known = index.get
    cost, back = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost(q) + q ascending, with q and its index
    push, pop, drop = queue.append, queue.pop, queue.popleft
    short = [p for p in powers if p < width]
    for i in range(1, len(where)):
        p = where[i]
        while queue[0][1] < p - width:
            drop()
        low, _, b = queue[0]
        best = low + width - p
        for s in short:
            j = known(p - s)
            if j is not None and cost[j] + SHORT_WINDOW < best:
                best, b = cost[j] + SHORT_WINDOW, j
        cost[i], back[i] = best + pen[i], b
        key = cost[i] + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, i))
    out, i = [], len(where) - 1
    while i:
        out.append(where[i])
        i = back[i]
    return [0, *out[::-1]]


def pack(ids: list[bytes], ends_sentence: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, start, length, crc32, sequence, offset) of each piece of documents given by their ids."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    ends = np.cumsum(lengths)
    data = b"".join(ids)
    stream = np.frombuffer(data, "<u4")
    sentence = np.flatnonzero(ends_sentence[stream]) + 1
    at = cuts(*places(ends, sentence), width)
    view = memoryview(data)
    edges = _ascending([0], ends, at)
    doc = np.searchsorted(ends, edges[:-1], "right")
    seq = np.searchsorted(np.array(at[1:]), edges[:-1], "right")
    begin = (ends - lengths)[doc]
    opened = np.array(at)[seq]
    for d, s, e, q, b, o in zip(doc.tolist(), edges[:-1].tolist(), edges[1:].tolist(), seq.tolist(), begin.tolist(), opened.tolist(), strict=True):
        yield d, s - b, e - s, zlib.crc32(view[4 * s : 4 * e]), q, s - o


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its text closes a sentence or a line."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    size = t.get_vocab_size(with_added_tokens=True)
    out = np.zeros(size, bool)
    for i, s in enumerate(t.decode_batch([[k] for k in range(size)], skip_special_tokens=False)):
        out[i] = s.rstrip(" \"')")[-1:] in {".", "!", "?", "\n", "。"}
    return out


def packed(
    docs: DataFrame, path: str, end_id: int = END_ID, width: int = WIDTH, stretch: int = STRETCH, pieces: int | None = None
) -> DataFrame:
    """The pieces of all documents; a sequence's id has its partition in the upper bits. `pieces` bounds what an encoder keeps."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closes = encoder(path, pieces).encode, sentence_ends(path)
        base = TaskContext.get().partitionId() << 36
        doc_ids, held, size = [], [], 0

        def flush() -> tuple[pa.RecordBatch, int]:
            d, s, n, crc, q, o = (np.array(c, np.int64) for c in zip(*pack(held, closes, width), strict=True))
            tokens = np.array([len(x) // 4 for x in held], np.int64)[d]
            own = pa.array(doc_ids, pa.int64()).take(pa.array(d))
            return pa.RecordBatch.from_arrays([own, *map(pa.array, (s, n, crc, tokens, q + base, o))], schema=schema), int(q[-1]) + 1

        for whole in it:
            for b in groups_of(whole, 1):
                for d, x in zip(b.column(0).to_pylist(), encode(texts_of(b.column(1))), strict=True):
                    doc_ids.append(d)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= stretch:
                        out, used = flush()
                        yield out
                        base += used
                        doc_ids, held, size = [], [], 0
        if held:
            yield flush()[0]
        give_back()

    return by_id(docs).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
