"""Metrics and hashes of grey rasters held as arrays, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions import scalars as S


def metrics(px: DataFrame, key: str = "id", gray: str = "gray") -> DataFrame:
    """(key, luminance, contrast, dark_clip, bright_clip): mean, population deviation, and shares at either end."""
    x, n = F.col(gray), F.size(gray)
    mean = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v) / n
    square = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v * v)
    dev = F.sqrt((square * n - F.pow(F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v), 2)) / (n * n))
    share = lambda f: F.round(F.size(F.filter(x, f)) / n, 5)
    return px.select(key, F.round(mean, 3).alias("luminance"), F.round(dev, 3).alias("contrast"), share(lambda v: v <= 8).alias("dark_clip"), share(lambda v: v >= 247).alias("bright_clip"))


def sharpness(px: DataFrame, width: int, height: int, key: str = "id", gray: str = "gray") -> DataFrame:
    """(key, sharpness): population variance of the four-neighbour Laplacian over inner pixels."""
    inner = [r * width + c for r in range(1, height - 1) for c in range(1, width - 1)] if width * height <= 256 else None
    g = lambda i: F.element_at(F.col(gray), i + 1)
    at = F.array(*map(F.lit, inner)) if inner else F.filter(F.sequence(F.lit(width), F.lit(width * (height - 1) - 1)), lambda i: (i % width > 0) & (i % width < width - 1))
    lap = F.transform(at, lambda i: g(i - 1) + g(i + 1) + g(i - width) + g(i + width) - 4 * g(i))
    total = lambda f: F.aggregate(F.col("_lap"), F.lit(0).cast("long"), f)
    n = F.size("_lap")
    return px.withColumn("_lap", lap).select(key, F.round((total(lambda s, v: s + v * v) * n - F.pow(total(lambda s, v: s + v), 2)) / (n * n), 3).alias("sharpness"))


def entropy(px: DataFrame, key: str = "id", gray: str = "gray") -> DataFrame:
    """(key, entropy) in bits over occupied grey levels."""
    bins = px.select(key, F.size(gray).alias("n"), F.explode(gray).alias("v")).groupBy(key, "v").agg((F.count("*") / F.first("n")).alias("p"))
    return bins.groupBy(key).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))


def dhash(gray: Column, width: int = 9, height: int = 8) -> Column:
    """Bits, first pixel highest, of whether the right neighbour is lighter."""
    bits = [F.when(gray[r * width + c + 1] > gray[r * width + c], F.lit(1 << (63 - (r * 8 + c)) if r * 8 + c else -(1 << 63))).otherwise(F.lit(0)).cast("long") for r in range(height) for c in range(width - 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _cosines(n: int = 32) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    c = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


_LOW = _cosines()[:8]  # the low frequencies, eight of 32


def phashes_of(pixels: np.ndarray) -> np.ndarray:
    """Of rasters (n, 1024) of 32 x 32, 64 bits each: low frequencies above the median of all but the first row."""
    low = _LOW @ pixels.astype(np.float64).reshape(-1, 32, 32) @ _LOW.T
    bits = (low > np.median(low[:, 1:].reshape(len(low), -1), axis=1)[:, None, None]).reshape(len(low), 64)
    return np.packbits(bits, axis=1).view(">u8").ravel()


def phash(px: DataFrame, key: str = "id", gray: str = "gray") -> DataFrame:
    """(key, phash): 16 hex digits of 32 x 32 rasters, a batch at a time; null for rasters of another size."""
    kind = px.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fits = pc.equal(pc.list_value_length(b.column(1)), 1024).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fits == True)  # noqa: E712 null is no match
            out: list[str | None] = [None] * b.num_rows
            if len(at):
                flat = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                for i, h in zip(at.tolist(), phashes_of(flat.reshape(len(at), 1024)).tolist(), strict=True):
                    out[i] = f"{h:016x}"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "phash"])

    return px.select(key, gray).mapInArrow(run, f"{key} {kind}, phash string")


def still_frame(frames: DataFrame, stills: DataFrame, key: str = "id") -> DataFrame:
    """The frame of a clip (key, frame, pixels) nearest its still (key, pixels), rasters standardised with deviation at least 1."""
    a = frames.select(key, "frame", S.standardised(F.col("pixels")).alias("a"))
    b = stills.select(key, S.standardised(F.col("pixels")).alias("b"))
    error = F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a"), 9)
    return a.join(b, key).select(key, "frame", error.alias("mse")).groupBy(key).agg(F.min_by("frame", F.struct("mse", "frame")).alias("frame"), F.min("mse").alias("mse"))


def best_frame(frames: DataFrame, key: str = "id") -> DataFrame:
    """The frame (key, time_ms, score) of highest score, the earliest among equals."""
    return frames.groupBy(key).agg(F.max_by(F.struct("time_ms", "score"), F.struct("score", -F.col("time_ms"))).alias("f")).select(key, "f.time_ms", "f.score")
