"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are classed by the bit counts of their upper and lower halves. Two fingerprints that
differ in at most r bits have half counts that differ by at most r in sum, so only tile pairs of such classes
are compared, with numpy's exclusive-or and bit counts; inside a pair, runs of rows whose byte counts are too
far apart are skipped the same way. Both bounds are necessary conditions, so no link is lost. Class counts
(33 x 33 at most) size the tiles: a class with more rows than a tile is split, whatever its share of the rows.
A tile pair returns a spanning forest of its links, never the pairs.

Null text counts as empty; a text without words has fingerprint zero, which links like any other. Repeated rows
are rows of one fingerprint. A null doc_id never becomes a component's name; a group of only such rows has
component null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import components, forest, in_slices, partitions_for, table, texts_as_bytes, written

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE_ROWS = 65_536
RUN = 256
_BLOCK = 21  # bits of a block's number in a tile's; the two classes take the other 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return _majority(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def _majority(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            fp = np.array([fingerprint(t, shingle) for t in texts_as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _runs(fp: np.ndarray, ids: np.ndarray) -> tuple:
    """Rows ordered by byte counts, and the least and most of each byte's count in each run of rows."""
    byte = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8))
    order = np.lexsort(byte.T)
    fp, ids, byte = fp[order], ids[order], byte[order].astype(np.int16)
    starts = np.arange(0, len(fp), RUN)
    return fp, ids, np.minimum.reduceat(byte, starts), np.maximum.reduceat(byte, starts)


def tile_links(fa: np.ndarray, ia: np.ndarray, fb: np.ndarray, ib: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles of fingerprints (uint64) with their ids."""
    fa, ia, alo, ahi = _runs(fa, ia)
    fb, ib, blo, bhi = (fa, ia, alo, ahi) if same else _runs(fb, ib)
    us, vs, held = [], [], 0
    for k in range(len(alo)):
        apart = np.maximum(0, np.maximum(alo[k] - bhi, blo - ahi[k])).sum(1)
        near = np.flatnonzero(apart <= radius)
        if same:
            near = near[near >= k]
        for part in (near[i : i + 64] for i in range(0, len(near), 64)):
            cols = (part[:, None] * RUN + np.arange(RUN)).ravel()
            cols = cols[cols < len(fb)]
            a = slice(k * RUN, (k + 1) * RUN)
            x, y = np.nonzero(np.bitwise_count(fa[a, None] ^ fb[None, cols]) <= radius)
            u, v = ia[a][x], ib[cols[y]]
            us.append(u[u != v])
            vs.append(v[u != v])
            held += len(us[-1])
            if held > 1 << 20:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else forest(np.empty(0, np.int64), np.empty(0, np.int64))


def links(reps: DataFrame, parts: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): a spanning forest, tile pair by tile pair, of distinct fingerprints (fp, rep) within the radius."""
    halves = reps.select("fp", "rep", F.expr("cast(bit_count(shiftrightunsigned(fp, 32)) as int)").alias("hi"), F.expr("cast(bit_count(fp & 4294967295L) as int)").alias("lo"))
    counts = np.zeros((33, 33), np.int64)
    for r in halves.groupBy("hi", "lo").count().collect():  # 33 x 33 classes at most
        counts[r["hi"], r["lo"]] = r["count"]
    blocks = -(-counts // tile_rows)
    if blocks.max() >= 1 << _BLOCK:
        raise ValueError(f"a class of {counts.max()} fingerprints needs larger tiles than {tile_rows} rows")
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    out = pa.schema([("tile", pa.int64()), ("side", pa.int8()), ("fp", pa.int64()), ("rep", pa.int64())])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp, rep, hi, lo = (np.asarray(c) for c in b.columns)
            own = hi * 33 + lo
            block = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % np.maximum(1, blocks[hi, lo])
            for dx, dy in steps:
                x, y = hi + dx, lo + dy
                ok = (x >= 0) & (x <= 32) & (y >= 0) & (y <= 32)
                x, y = np.where(ok, x, 0), np.where(ok, y, 0)
                other, others = x * 33 + y, np.where(ok, blocks[x, y], 0)
                for j in range(int(others.max(initial=0))):
                    sel = others > j
                    o, m, i = other[sel], own[sel], block[sel]
                    first = (m < o) | ((m == o) & (i <= j))  # the side with the smaller (class, block) leads
                    tile = np.where(first, m, o).astype(np.int64)
                    tile = (tile * 1089 + np.where(first, o, m)) << 2 * _BLOCK | np.where(first, i, j) << _BLOCK | np.where(first, j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array((~first).astype(np.int8)), pa.array(fp[sel]), pa.array(rep[sel])], schema=out)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[list]:
            held: list[list] = []
            for b in it:
                t = np.asarray(b.column(0))
                cols = [np.asarray(c) for c in b.columns[1:]]
                cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    if held and held[0][0] != t[s]:
                        yield held
                        held = []
                    held.append([t[s], *(c[s:e] for c in cols)])
            if held:
                yield held

        for held in tiles():
            side, fp, rep = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            fp = fp.view(np.uint64)
            at = int(held[0][0])
            pair, mask = divmod(at >> 2 * _BLOCK, 1089), (1 << _BLOCK) - 1
            same = pair[0] == pair[1] and at >> _BLOCK & mask == at & mask
            a, b = side == 0, side == 1
            if not same and not (a.any() and b.any()):
                continue
            u, v = tile_links(fp[a], rep[a], fp[b], rep[b], same, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = halves.mapInArrow(deal, "tile long, side byte, fp long, rep long")
    return dealt.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs."""
    parts = partitions_for(docs)
    prints = written(fingerprints(docs, shingle), "prints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    near = components(links(reps.where("rep is not null"), parts, radius, tile_rows), "simhash")
    named = reps.join(near, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
