"""File sources and sinks: folder listings, decoded rasters, decision tables and versioned snapshots."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The extensions that count as photos and clips.
COMMON = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
HEIF = ("heic", "heif", "hif", "heics", "heifs")
RAW = ("arw", "cr2", "cr3", "dng", "nef", "orf", "pef", "raf", "rw2")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mts", "m2ts", "3gp", "wmv")
IMAGE = (*COMMON, *HEIF, *RAW)

ROWS_AT_ONCE = 10_000
LISTING = T.StructType([T.StructField("relative_path", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType())])


def _listed(base: str, top: str, skip: tuple[str, ...], deep: bool) -> Iterator[tuple]:
    """Rows of the files in a folder, and of those below it if deep; links are not followed."""
    for folder, dirs, names in os.walk(os.path.join(base, top), followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in skip and not os.path.islink(os.path.join(folder, d))) if deep else []
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.commonpath([base, os.path.realpath(path)]) != base:
                continue
            stat = os.stat(path)
            yield os.path.relpath(path, base).replace(os.sep, "/"), os.path.splitext(name)[1].lower().lstrip("."), stat.st_size, stat.st_mtime


def list_folder(spark: SparkSession, root: str, skip: tuple[str, ...] = ("_quarantine", "_cache")) -> DataFrame:
    """(relative_path, ext, size, mtime) of files under root; links are not followed, nothing outside root is listed.

    The driver sees only the folders directly in root; each is walked by a task, which must see root too.
    """
    base = os.path.realpath(root)
    own = spark.createDataFrame(list(_listed(base, "", skip, False)), LISTING)
    with os.scandir(base) as it:
        tops = sorted(e.name for e in it if e.is_dir(follow_symlinks=False) and e.name not in skip)
    if not tops:
        return own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for top in b["top"]:
                rows = _listed(base, top, skip, True)
                while part := list(islice(rows, ROWS_AT_ONCE)):
                    yield pd.DataFrame(part, columns=LISTING.names)

    folders = spark.createDataFrame([(t,) for t in tops], "top string").repartition(min(len(tops), 1000))
    return own.unionByName(folders.mapInPandas(run, LISTING))


def inside(root: str, relative: str) -> str:
    """The path of an untrusted relative name, refused if it leaves root."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, relative))
    if os.path.isabs(relative) or os.path.commonpath([base, path]) != base:
        raise ValueError(f"{relative!r} leads out of the folder")
    return path


def decode_images(listing: DataFrame, root: str, side: int = 512) -> DataFrame:
    """(relative_path, width, height, gray, error) of photos, by a decoder library where one is installed."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from PIL import Image, ImageOps
        except ImportError:
            Image = None
        for b in it:
            out = []
            for rel in b["relative_path"]:
                try:
                    if Image is None:
                        raise ImportError("no image decoder is installed")
                    with Image.open(inside(root, rel)) as im:
                        im = ImageOps.exif_transpose(im).convert("RGB")
                        w, h = im.size
                        im.thumbnail((side, side), Image.Resampling.LANCZOS)
                        out.append((rel, w, h, list(im.convert("L").tobytes()), ""))
                except Exception as e:  # an unreadable photo is a row with an error  # noqa: BLE001
                    out.append((rel, 0, 0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["relative_path", "width", "height", "gray", "error"])

    return listing.where(F.col("ext").isin(*IMAGE)).select("relative_path").mapInPandas(run, "relative_path string, width int, height int, gray array<int>, error string")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(line, path, decision) of a table with Chinese or English headings, a byte order mark aside."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip().lower() for c in raw.columns))

    def column(*names: str) -> F.Column:
        return F.coalesce(*(F.col(f"`{n}`") for n in names if n in raw.columns), F.lit(None).cast("string"))

    return raw.select(F.monotonically_increasing_id().alias("line"), F.regexp_replace(column("路径", "path"), r"\\", "/").alias("path"), column("决定", "decision").alias("decision"))


def atomic_write(path: str, text: str) -> None:
    """A file appears whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temp, path)


def write_decisions(rows: DataFrame, path: str) -> None:
    """Decided rows as one spreadsheet-ready file: byte order mark, CRLF, ordered as given, rows streamed."""
    import csv

    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(["决定", "路径", "建议", "原因"])  # fixed values: the headings
        for r in rows.toLocalIterator():
            out.writerow([r["decision"], r["relative_path"], r["suggestion"], r["reason"]])
    os.replace(temp, path)


# The manifest's fields, each with the column it comes from.
MANIFEST = {
    "photo_id": "id",
    "relative_path": "relative_path",
    "quarantine_path": "target",
    "restore_path": "back_to",
    "companion_relative_path": "motion_relative_path",
    "companion_quarantine_path": "motion_target",
    "companion_restore_path": "motion_back_to",
    "status": "state",
    "size": "size",
    "error": "error",
}


def _swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """A folder of files appears whole or not at all: written beside its place, then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(aside)
    to = hadoop(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) and not fs.rename(to, hadoop(old)):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(hadoop(aside), to):
        raise OSError(f"{path} cannot be put in place")
    fs.delete(hadoop(old), True)


def write_manifest(rows: DataFrame, folder: str) -> None:
    """A batch's manifest as CSV with fixed fields, missing ones empty, and as JSON lines."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f) if c in rows.columns else F.lit("").alias(f) for f, c in MANIFEST.items()]
    spark = rows.sparkSession
    _swapped(spark, f"{folder}/csv", lambda to: rows.select(*cols).write.option("header", True).option("emptyValue", "").csv(to))
    _swapped(spark, f"{folder}/json", lambda to: rows.write.json(to))


def write_thumbnails(rows: DataFrame, folder: str, side: int = 512, quality: int = 86) -> DataFrame:
    """(name, error) of rasters (name, height, width, rgb binary) written as JPEG files of at most side pixels.

    A file is replaced at once or not at all; one that cannot be made leaves an older one as it was. The folder must
    be one that every executor sees.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for name, h, w, rgb in zip(b["name"], b["height"], b["width"], b["rgb"], strict=True):
                try:
                    from PIL import Image

                    path = inside(folder, name)
                    image = Image.frombytes("RGB", (int(w), int(h)), bytes(rgb))
                    image.thumbnail((side, side), Image.Resampling.LANCZOS)
                    temp = f"{path}.{uuid.uuid4().hex}"
                    try:
                        image.save(temp, "JPEG", quality=quality)
                        os.replace(temp, path)
                    finally:
                        if os.path.exists(temp):
                            os.unlink(temp)
                    out.append((name, ""))
                except Exception as e:  # a thumbnail that fails is a row with an error  # noqa: BLE001
                    out.append((name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "error"])

    return rows.select("name", "height", "width", "rgb").mapInPandas(run, "name string, error string")


def read_heads(listing: DataFrame, root: str, most: int = 2 << 20) -> DataFrame:
    """(relative_path, size, head): the first bytes of JPEG files as text, what is no UTF-8 left out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for rel in b["relative_path"]:
                try:
                    path = inside(root, rel)
                    with open(path, "rb") as f:
                        out.append((rel, os.path.getsize(path), f.read(most).decode("utf-8", "ignore")))
                except (OSError, ValueError):
                    out.append((rel, None, ""))
            yield pd.DataFrame(out, columns=["relative_path", "size", "head"])

    some = listing.where(F.col("ext").isin("jpg", "jpeg")).select("relative_path")
    return some.mapInPandas(run, "relative_path string, size long, head string")


class Snapshots:
    """Versioned Parquet snapshots of a table: a version is written whole, then a pointer file is swapped."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, defaults: dict, version: int = 4) -> None:
        self.spark, self.root, self.schema, self.defaults, self.version = spark, root, schema, defaults, version
        os.makedirs(root, exist_ok=True)

    def _pointer(self) -> dict | None:
        path = os.path.join(self.root, "current.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def read(self) -> DataFrame:
        """The current snapshot; columns added since it was written have their defaults, a newer schema is refused."""
        p = self._pointer()
        if p is None:
            return self.spark.createDataFrame([], self.schema)
        if p["version"] > self.version:
            raise ValueError(f"the snapshot has schema version {p['version']}, this is {self.version}")
        df = self.spark.read.parquet(os.path.join(self.root, p["folder"]))
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(self.defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema))

    def write(self, df: DataFrame) -> None:
        p = self._pointer()
        folder = f"v{0 if p is None else int(p['folder'][1:]) + 1}"
        df.select(*(f.name for f in self.schema)).write.mode("overwrite").parquet(os.path.join(self.root, folder))
        atomic_write(os.path.join(self.root, "current.json"), json.dumps({"folder": folder, "version": self.version}))
