"""Repeated passages by super-k-mer partitioning.

A window is `k` consecutive words. Its minimiser is the smallest hash of the m-word runs inside it; consecutive
windows that share a minimiser form a super-k-mer, which travels once, as one packed string, to the bucket its
minimiser names. All windows of one word sequence have one minimiser and so meet in one bucket, where sorting the
windows themselves finds the first (smallest doc_id, then start) and marks the others.

Hot runs: word runs common enough to fill a bucket by themselves are taken last as minimisers, so that windows that
hold another run spread by that one. They are found on a sample of texts that grows with the number of buckets; the
sample decides only which bucket a window goes to, never what is a repeat.

Hot passages: a super-k-mer that a task still holds from an earlier place is marked on the spot, string against
string, so it costs at most one row a flush however often it occurs. Strings travel compressed, many to a row, and a
bucket is a partition. In a bucket only minimisers with two occurrences are opened; occurrences of one minimiser are
compared window by window with a sort.

Null text counts as having no words. Rows that share a doc_id and text are one document met twice: neither starts
earlier, so they lose the same words; texts that differ under one doc_id are told apart by 32 bits of their hash,
and windows of them compared by start alone. A null doc_id sorts before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import give_back, in_slices, partitions_for, table

WINDOW = 20
RUN = 3
LEVEL = 3
FLUSH_BYTES = 32 << 20
WORDS_HELD = 200_000
SAMPLE_TEXTS = 2_000  # for hot runs; or SAMPLE_A_BUCKET for each bucket, if more
SAMPLE_A_BUCKET = 16
HOT_RUNS = 65_536
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(1 << 63)
_HEAD = np.dtype([("mini", "<u8"), ("doc", "<i8"), ("own", "<u4"), ("start", "<u4"), ("windows", "<u4"), ("size", "<u4")])
_OFTEN = 1 << 31  # in windows: the minimiser occurs more than once


class Words:
    """64-bit hashes of words, those met often kept."""

    def __init__(self) -> None:
        self.held: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        try:
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(held) > WORDS_HELD:
                held.clear()
            for w in words:
                if w not in held:
                    held[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def _worker_words() -> Words:
    """One a worker process, whose tasks share it."""
    return Words()


def runs_of(h: np.ndarray, m: int = RUN) -> np.ndarray:
    """63-bit hashes of the runs of m words, from the words' hashes."""
    g = h.copy()
    for _ in range(m - 1):
        g = (g[:-1] ^ (g[:-1] >> np.uint64(29))) * _ODD + h[len(h) - len(g) + 1 :]
    g = (g ^ (g >> np.uint64(32))) * _ODD
    return (g ^ (g >> np.uint64(29))) >> np.uint64(1)


def super_kmers(
    h: np.ndarray, k: int = WINDOW, m: int = RUN, hot: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a document's word hashes, and whether
    its minimiser occurs in it more than once. Runs in hot (ascending) come after all others."""
    n = len(h) - k + 1
    g = runs_of(h, m)
    if hot is not None and len(hot):
        g = np.where(hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g, g | _LAST, g)
    width, low, span = k - m + 1, g, 1
    while span < width:  # smallest of each width runs, by doubling
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    windows = np.diff(np.append(first, n))
    mini = low[first]
    at = np.flatnonzero(g == np.repeat(mini, windows + width - 1)[0]) if len(first) == 1 else None
    if at is not None:
        often = np.array([len(at) > 1])
    else:
        # the minimiser's places: each window's smallest is at one place unless equal runs recur
        eq = g[np.repeat(first, windows + width - 1) + _within(windows + width - 1)] == np.repeat(mini, windows + width - 1)
        often = np.add.reduceat(eq, np.cumsum(windows + width - 1) - (windows + width - 1)) > 1
    return mini, first, windows, often


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def later_windows(rows: list[tuple[tuple, int, bytes, int]], k: int = WINDOW) -> Iterator[tuple[int, int]]:
    """For occurrences (document key, first window, packed words, windows) of one minimiser, the (row, window) of every window that also starts earlier."""
    found = []
    for i, (_, start, text, n) in enumerate(rows):
        ends = np.flatnonzero(np.frombuffer(text + b" ", np.uint8) == 32).tolist()
        begins = [0, *(e + 1 for e in ends)]
        found += [(text[begins[j] : ends[j + k - 1]], rows[i][0], start + j, i) for j in range(n)]
    found.sort()
    was, first = None, None
    for w, doc, at, i in found:
        if w != was:
            was, first = w, (doc, at)
        elif (doc, at) != first:
            yield i, at


def _spans(at: list[int], k: int) -> list[tuple[int, int]]:
    """Word ranges that windows starting at these places cover."""
    out: list[list[int]] = []
    for a in sorted(at):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + k)
        else:
            out.append([a, a + k])
    return [(s, e) for s, e in out]


def _columns(heads: list[bytes]) -> bytes:
    """Heads field by field, which compresses better, after their number."""
    h = np.frombuffer(b"".join(heads), _HEAD)
    return struct.pack("<I", len(h)) + b"".join(h[f].tobytes() for f in _HEAD.names)


def _heads(raw: bytes) -> tuple[np.ndarray, int]:
    """The heads of a blob and where its texts start."""
    n, at = struct.unpack_from("<I", raw)[0], 4
    h = np.empty(n, _HEAD)
    for f in _HEAD.names:
        kind = _HEAD[f]
        h[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return h, at


OUT = "bucket int, doc_id long, own long, spans binary, blob binary"
_OUT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("own", pa.int64()), ("spans", pa.binary()), ("blob", pa.binary())])
_NONE = -(1 << 63)


def hot_runs(rows: DataFrame, buckets: int, k: int = WINDOW, m: int = RUN) -> np.ndarray:
    """Runs (ascending, at most HOT_RUNS) that could hold half a bucket's fair share of all windows, by a sample of rows (text)."""
    texts = rows.select("text")
    fraction = max(SAMPLE_TEXTS, SAMPLE_A_BUCKET * buckets) / max(1, texts.count())
    if fraction < 1:
        texts = texts.sample(fraction, seed=1)
    schema = pa.schema([("run", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _worker_words()
        for b in in_slices(it):
            lists = [w for t in b.column(0).cast(pa.binary()).to_pylist() if t and len(w := t.split()) >= k]
            if lists:
                run_, n = np.unique(np.concatenate([runs_of(words_of.hashes(w), m) for w in lists]), return_counts=True)
                all_ = [pa.array([None, *run_.view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(all_, schema=schema)

    counts = texts.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), F.asc_nulls_first("run")).limit(HOT_RUNS + 1).collect()  # the null row, all runs, is first
    least = max(8, most[0]["n"] / (2 * (k - m + 1) * buckets)) if most else 0
    return np.array(sorted(r["run"] for r in most if r["run"] is not None and r["n"] >= least), np.uint64)


def scatter(docs: DataFrame, buckets: int, k: int = WINDOW, m: int = RUN, hot: np.ndarray | None = None) -> DataFrame:
    """Rows (bucket, blob) of packed super-k-mers, and rows (doc_id, own, spans) of what a task could mark itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, press = _worker_words(), zstandard.ZstdCompressor(level=LEVEL)
        seen: dict[bytes, tuple[int, int, int]] = {}  # the strings held now and the first place of each
        heads: list[list[bytes]] = [[] for _ in range(buckets)]
        texts: list[list[bytes]] = [[] for _ in range(buckets)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            own = [i for i in range(buckets) if heads[i]]
            seen.clear()
            for part in (own[i : i + 16] for i in range(0, len(own), 16)):
                blobs = [press.compress(_columns(heads[i]) + b"".join(texts[i])) for i in part]
                for i in part:
                    heads[i], texts[i] = [], []
                none = [None] * len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((part, none, none, none, blobs), _OUT, strict=True)], schema=_OUT)
            size = 0

        for b in in_slices(it):
            local: dict[tuple[int, int], list[int]] = {}
            for doc, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                if len(words) < k:
                    continue
                doc = _NONE if doc is None else doc
                packed = b" ".join(words)
                edge = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                minis, firsts, counts, often = super_kmers(words_of.hashes(words), k, m, hot)
                s, e = (edge[firsts] - [len(words[i]) + 1 for i in firsts.tolist()]).tolist(), (edge[firsts + counts + k - 2] - 1).tolist()
                head = np.zeros(len(minis), _HEAD)
                head["mini"], head["doc"], head["own"], head["start"] = minis, doc, own, firsts
                head["windows"], head["size"] = counts | np.where(often, _OFTEN, 0), np.array(e) - np.array(s)
                raw, wide = head.tobytes(), _HEAD.itemsize
                for i, (to, f, x, y) in enumerate(zip((minis % np.uint64(buckets)).tolist(), firsts.tolist(), s, e, strict=True)):
                    t = packed[x:y]
                    was = seen.get(t)
                    if was is not None and was < (doc, f):
                        local.setdefault((doc, own), []).extend(range(f, f + int(counts[i])))
                        continue
                    if was == (doc, f, own):  # a row met twice
                        continue
                    seen[t] = (doc, f, own)
                    heads[to].append(raw[i * wide : (i + 1) * wide])
                    texts[to].append(t)
                    size += len(t) + wide
                if size > FLUSH_BYTES:
                    yield from flush()
            if local:
                rows = [((d ^ o) % buckets, None if d == _NONE else d, o, np.array(_spans(at, k), "<u4").tobytes(), None) for (d, o), at in local.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
        yield from flush()

    return docs.mapInArrow(run, OUT)


def gather(rows: DataFrame, buckets: int, k: int = WINDOW) -> DataFrame:
    """(doc_id, own, spans): what each bucket marks, as word ranges, and what the tasks before marked themselves."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("spans", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        heads, texts = [], []

        def mark() -> Iterator[pa.RecordBatch]:
            head = np.concatenate(heads)
            data = b"".join(texts)
            heads.clear(), texts.clear()
            ends = np.cumsum(head["size"].astype(np.int64))
            order = np.argsort(head["mini"], kind="stable")
            mini = head["mini"][order]
            cut = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1, [len(mini)]])
            open_ = np.flatnonzero((np.diff(cut) > 1) | np.logical_or.reduceat(head["windows"][order] >= _OFTEN, cut[:-1]))
            found: dict[tuple[int, int], list[int]] = {}
            for s, e in zip(cut[open_].tolist(), cut[open_ + 1].tolist(), strict=True):
                rows = []
                for i in order[s:e].tolist():
                    h = head[i]
                    x = int(ends[i])
                    rows.append((int(h["doc"]), int(h["start"]), data[x - int(h["size"]) : x], int(h["windows"]) % _OFTEN, int(h["own"])))
                for i, at in later_windows([r[:4] for r in rows], k):
                    found.setdefault((rows[i][0], rows[i][4]), []).append(at)
            if found:
                out = [(None if d == _NONE else d, o, np.array(_spans(at, k), "<u4").tobytes()) for (d, o), at in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in it:
            done = b.filter(pc.is_valid(b.column("spans")))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(n) for n in schema.names], schema=schema)
            for blob in b.column("blob").drop_null():
                raw = press.decompress(blob.as_buffer())
                head, after = _heads(raw)
                heads.append(head)
                texts.append(raw[after:])
        if heads:
            yield from mark()
        give_back()

    return rows.repartitionById(buckets, "bucket").mapInArrow(run, "doc_id long, own long, spans binary")


def cut_words(words: list[bytes], spans: list[bytes]) -> list[bytes]:
    """The words outside all spans."""
    gone = np.zeros(len(words) + 1, np.int32)
    for s, e in (r for x in spans for r in np.frombuffer(x, "<u4").reshape(-1, 2).tolist()):
        gone[s] += 1
        gone[min(e, len(words))] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = RUN, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and the kept text if asked for, of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("xxhash64(coalesce(cast(text as string), '')) & 4294967295").alias("own"), F.col("text").cast("string").alias("text"))
    buckets = partitions_for(docs) * 3 // 2  # super-k-mers hold about three times their text
    marked = gather(scatter(rows, buckets, k, m, hot_runs(rows, buckets, k, m)), buckets, k)
    spans = marked.groupBy("doc_id", "own").agg(F.collect_list("spans").alias("spans"))  # one document's, bounded by its length
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.own") == F.col("s.own")), "left").select("d.doc_id", "d.text", "s.spans")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if with_text else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            n, gone, sha, kept_text = [], [], [], []
            for text, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                kept = cut_words(words, s) if s else words
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_text.append(joined.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept_text, pa.string())] if with_text else [])], schema=schema)

    return joined.mapInArrow(run, kind)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
