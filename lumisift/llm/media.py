"""Media columns: ISO base media containers, written and walked without decoding payloads.

mux() stores bytes losslessly as 8-bit samples of an uncompressed RGB track ('raw '): 192 bytes are one 8 x 8
frame, and every GOP-th frame is listed as a sync sample. inspect() walks nested boxes of any container (64-bit
and to-the-end sizes, both versions of the time boxes, 32- and 64-bit chunk offsets, whole and compact size tables,
tables with runs, movie fragments) and returns each track's codec, duration and the byte ranges of its samples and
keyframes, from the sample tables alone. Counts are held against the box and the file before anything is made of
them; a broken container gives no tracks and an error text, whatever its bytes.

Null text counts as empty; the payload is padded with spaces to a positive multiple of 192. The containers are a
written table, which media_features() reads back. Repeated rows give repeated results; a null doc_id is passed
through. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import in_slices, table, texts_as_bytes, written

FRAME, SIDE, RATE, GOP = 192, 8, 25, 12
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"mvex"}
MOST_NESTED = 64


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def mux(payload: bytes) -> bytes:
    """A container whose only track holds payload, a positive multiple of 192 bytes, as raw frames."""
    n = len(payload) // FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"stco", struct.pack(">II", 1, len(ftyp) + 8)),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return ftyp + _box(b"mdat", payload) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def walk(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, body start, body end) of every box, nested ones after their parents."""
    open_: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            if path[-1:] == (b"udta",) and not any(data[start:end]):
                continue  # user data may end in a zero
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"no room for a 64-bit size at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield (*path, kind), start + head, start + size
        open_.append((start + size, end, path))
        if kind in _NESTED:
            if len(path) >= MOST_NESTED:
                raise ValueError(f"boxes are nested deeper than {MOST_NESTED}")
            open_.append((start + head, start + size, (*path, kind)))


def _table(data: bytes, at: int, end: int, width: int, kind: str) -> np.ndarray:
    """The rows of a counted table that starts at `at`."""
    n = struct.unpack_from(">I", data, at)[0]
    size = n * width * np.dtype(kind).itemsize
    if at + 4 + size > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, at + 4).reshape(n, width).astype(np.int64)


def _sizes(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Length of every sample, by a whole or a compact size table."""
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        each, n = struct.unpack_from(">II", data, at + 4)
        if each:
            if each * n > len(data):
                raise ValueError("samples are longer than the file")
            return np.full(n, each, np.int64)
        return _table(data, at + 8, end, 1, ">u4")[:, 0]
    at, end = boxes[b"stz2"]
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or at + 12 + -(-n * bits // 8) > end:
        raise ValueError("a table is longer than its box")
    if bits == 16:
        return np.frombuffer(data, ">u2", n, at + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), at + 12)
    return (raw if bits == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:n]).astype(np.int64)


def _samples(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of every sample."""
    sizes = _sizes(data, boxes)
    chunks = _table(data, boxes[b"co64"][0] + 4, boxes[b"co64"][1], 1, ">u8") if b"co64" in boxes else _table(data, boxes[b"stco"][0] + 4, boxes[b"stco"][1], 1, ">u4")
    chunks, runs = chunks[:, 0], _table(data, boxes[b"stsc"][0] + 4, boxes[b"stsc"][1], 3, ">u4")
    if not len(sizes) or not len(chunks) or not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if runs[0, 0] != 1 or (lengths <= 0).any() or (chunks < 0).any() or chunks.max() > 1 << 62:
        raise ValueError("chunks are not in order or lie beyond any file")
    per = np.minimum(np.repeat(runs[:, 1], lengths), len(sizes))
    last = np.minimum(np.cumsum(per), len(sizes))  # each at most the samples there are: no chunk makes more
    chunk = np.repeat(np.arange(len(chunks)), np.diff(last, prepend=0))
    if len(chunk) < len(sizes):
        raise ValueError("chunks hold fewer samples than the size table")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    return chunks[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk], sizes


def _fragments(data: bytes, boxes: list[tuple[tuple, int, int]]) -> dict[int, list[np.ndarray]]:
    """By track, rows (offset, length, duration, is a keyframe) of the samples that movie fragments hold."""
    usual = {}
    for path, s, e in boxes:
        if path[-2:] == (b"mvex", b"trex") and e - s >= 24:
            track, _, *rest = struct.unpack_from(">IIIII", data, s + 4)
            usual[track] = rest
    found: dict[int, list[np.ndarray]] = {}
    moof = track = at = 0
    duration = size = flags = 0
    for path, s, e in boxes:
        if path == (b"moof",):
            moof = next_ = s - 8
        elif path == (b"moof", b"traf", b"tfhd"):
            bits, track = struct.unpack_from(">II", data, s)
            duration, size, flags = usual.get(track, (0, 0, 0))
            base, at = (moof if bits & 0x20000 else next_), s + 8
            if bits & 0x1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(bits & 0x2)
            for bit in (0x8, 0x10, 0x20):
                if bits & bit:
                    value, at = struct.unpack_from(">I", data, at)[0], at + 4
                    duration, size, flags = (value if bit == b else x for b, x in ((0x8, duration), (0x10, size), (0x20, flags)))
            next_ = base
        elif path == (b"moof", b"traf", b"trun"):
            bits, n = struct.unpack_from(">II", data, s)
            at, place, first = s + 8, next_, None
            if bits & 0x1:
                place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            if bits & 0x4:
                first, at = struct.unpack_from(">I", data, at)[0], at + 4
            fields = [b for b in (0x100, 0x200, 0x400, 0x800) if bits & b]
            if at + 4 * len(fields) * n > e or not fields and (n > len(data) or size * n > len(data)):
                raise ValueError("a run is longer than its box")
            got = dict(zip(fields, np.frombuffer(data, ">u4", n * len(fields), at).reshape(n, -1).astype(np.int64).T, strict=True))
            sizes = got.get(0x200, np.full(n, size, np.int64))
            mark = got.get(0x400, np.full(n, flags, np.int64)).copy()
            if first is not None and n:
                mark[0] = first
            ends = np.cumsum(sizes) + place
            found.setdefault(track, []).append(np.stack([ends - sizes, sizes, got.get(0x100, np.full(n, duration, np.int64)), (mark & 0x10000 == 0).astype(np.int64)], 1))
            next_ = int(ends[-1]) if n else place
    return found


def inspect(data: bytes) -> tuple[list[dict], str]:
    """Tracks (codec, timescale, duration, width, height, samples, keyframes as (offset, length)), and what is wrong."""
    tracks: list[dict] = []
    try:
        boxes: list[dict[bytes, tuple[int, int]]] = []
        every = list(walk(data))
        for path, s, e in every:
            if path[:2] == (b"moov", b"trak"):
                if len(path) == 2:
                    boxes.append({})
                boxes[-1][path[-1]] = (s, e)
        fragments = _fragments(data, every) if any(p[0] == b"moof" for p, *_ in every) else {}
        for b in boxes:
            at = b[b"mdhd"][0]
            scale, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
            at, end = b[b"stsd"]
            if end - at < 16:
                raise ValueError("a track has no sample description")
            codec = data[at + 12 : at + 16].decode("latin-1")
            video = data[b[b"hdlr"][0] + 8 : b[b"hdlr"][0] + 12] == b"vide"
            width, height = struct.unpack_from(">HH", data, at + 8 + 32) if video else (0, 0)
            offset, size = _samples(data, b)
            keys = _table(data, b[b"stss"][0] + 4, b[b"stss"][1], 1, ">u4")[:, 0] - 1 if b"stss" in b else np.arange(len(size))
            keys = keys[(keys >= 0) & (keys < len(size))]
            if b"tkhd" in b and fragments:
                at = b[b"tkhd"][0]
                more = fragments.get(struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0], [])
                for rows in more:
                    keys = np.concatenate([keys, len(size) + np.flatnonzero(rows[:, 3])])
                    offset, size, ticks = np.concatenate([offset, rows[:, 0]]), np.concatenate([size, rows[:, 1]]), ticks + int(rows[:, 2].sum())
            if len(size) and (int(offset.min()) < 0 or int((offset + size).max()) > len(data)):
                raise ValueError("samples lie beyond the end")
            tracks.append({"codec": codec, "timescale": scale, "duration": ticks, "width": width, "height": height, "offset": offset, "size": size, "keys": keys})
    except (ValueError, KeyError, struct.error, IndexError, OverflowError) as e:
        return [], f"{type(e).__name__}: {e}"
    return tracks, ""


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a container."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            texts = texts_as_bytes(b.column(1))
            media = [mux(t.ljust(max(1, -(-len(t) // FRAME)) * FRAME)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACK = pa.struct([("codec", pa.string()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", _RANGES)])
_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_ms", pa.int64()),
    ("keyframes", _RANGES), ("tracks", pa.list_(_TRACK)), ("error", pa.string()),
])
_KIND = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_ms long, keyframes array<struct<offset:long,length:long>>, "
    "tracks array<struct<codec:string,duration_ms:long,samples:long,keyframes:array<struct<offset:long,length:long>>>>, error string"
)


def _track(t: dict) -> dict:
    """What is stored of a track."""
    k = t["keys"]
    ranges = [{"offset": o, "length": n} for o, n in zip(t["offset"][k].tolist(), t["size"][k].tolist(), strict=True)]
    ms = t["duration"] * 1000 // t["timescale"] if t["timescale"] else None
    return {"codec": t["codec"], "duration_ms": ms if ms is None or ms < 1 << 63 else None, "samples": len(t["size"]), "keyframes": ranges}


def _features(m: bytes | None) -> tuple:
    """The columns after n_bytes."""
    if m is None:
        return (None,) * 8 + ([], [], "no media")
    tracks, error = inspect(m)
    sha = hashlib.sha256(m).hexdigest()
    if not tracks:
        return (None, None, None, len(m), sha, None, None, None, [], [], error or "no track")
    t = tracks[0]
    offset, size, k = t["offset"], t["size"], t["keys"]
    if len(size) and np.array_equal(offset[1:], (offset + size)[:-1]):
        payload = m[offset[0] : offset[-1] + size[-1]]
    else:
        payload = b"".join(m[o : o + n] for o, n in zip(offset.tolist(), size.tolist(), strict=True))
    stored = [_track(x) for x in tracks]
    ms = stored[0]["duration_ms"]
    index = zlib.crc32(np.stack([offset[k], size[k]], 1).astype("<i8").tobytes())
    feature = f"{t['codec'].strip()};{t['width']}x{t['height']};samples={len(size)};ms={ms};keyframes={len(k)};ranges={index:08x}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), sha, feature, t["codec"], ms, stored[0]["keyframes"], stored, "")


def media_features(rows: DataFrame) -> DataFrame:
    """For (doc_id, n_bytes, media): the digests of the container and of its first track's samples, codec, duration and
    keyframe byte ranges, and of every track the same ranges (tracks)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            cols = list(zip(*map(_features, b.column(2).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(_FEATURES)[2:], strict=True))], schema=_FEATURES)

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, _KIND)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(encode_media(table(spark, sf_dir, "documents")), "media"))
