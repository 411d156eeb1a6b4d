"""Evaluation of blink detection: manifest and annotation tables, their faults, and the report's files."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.sources.files import atomic_write

# What counts as true, the states of a face, and the least sizes of a release's test.
TRUE = ("1", "true", "yes", "是")
STATES = ("open", "closed", "uncertain", "not_analyzable")
LEAST_PHOTOS, LEAST_GROUPS = 300, 60
GATES = {"precision": 0.95, "recall": 0.80, "recommendation_success_rate": 0.90, "p50": 50.0}


def _true(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE)


def _read(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    return raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, group_id, path, quality_score, authorized, license_id)."""
    raw = _read(spark, path)
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("photo_id", "group_id", "path", "license_id")}
    return raw.select(text["photo_id"], text["group_id"], text["path"], F.col("quality_score").try_cast("double").alias("quality_score"), F.coalesce(_true(F.col("authorized")), F.lit(False)).alias("authorized"), text["license_id"])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, face_id, x, y, width, height, status, primary); what is no number is null."""
    raw = _read(spark, path)
    primary = F.coalesce(_true(F.col("primary")), F.lit(True)) if "primary" in raw.columns else F.lit(True)
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("x", "y", "width", "height")]
    return raw.select("photo_id", "face_id", *numbers, F.lower(F.trim(F.coalesce("status", F.lit("")))).alias("status"), primary.alias("primary"))


def annotation_faults(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """(photo_id, fault): photos annotated but not in the manifest (unknown), and not annotated (missing)."""
    listed, seen = manifest.select("photo_id").distinct(), annotations.select("photo_id").distinct()
    unknown = seen.join(listed, "photo_id", "left_anti").select("photo_id", F.lit("unknown").alias("fault"))
    return unknown.unionByName(listed.join(seen, "photo_id", "left_anti").select("photo_id", F.lit("missing").alias("fault")))


def faults(manifest: DataFrame, annotations: DataFrame, photos: int = LEAST_PHOTOS, bursts: int = LEAST_GROUPS) -> DataFrame:
    """(photo_id, fault) of all that bars a release's test; what concerns the whole manifest has a null photo_id."""
    rows = manifest.select("photo_id", F.expr("case when photo_id = '' then 'no id' when not authorized then 'not authorised' when license_id = '' then 'no licence' end").alias("fault")).where("fault is not null")
    twice = manifest.groupBy("photo_id").count().where("count > 1 and photo_id <> ''").select("photo_id", F.lit("id used twice").alias("fault"))
    sizes = manifest.where("group_id <> ''").groupBy("group_id").count().agg(F.count_if(F.col("count") >= 2).alias("n"))
    few = manifest.agg(F.count("*").alias("n")).where(F.col("n") < photos).select(F.lit(None).cast("string").alias("photo_id"), F.lit("too few photos").alias("fault"))
    small = sizes.where(F.col("n") < bursts).select(F.lit(None).cast("string").alias("photo_id"), F.lit("too few bursts").alias("fault"))
    state = annotations.where(~F.col("status").isin(*STATES)).select("photo_id", F.lit("unknown state").alias("fault"))
    number = annotations.where("x is null or y is null or width is null or height is null").select("photo_id", F.lit("no number").alias("fault"))
    out = rows
    for more in (twice, few, small, state, number, annotation_faults(manifest, annotations)):
        out = out.unionByName(more)
    return out.distinct()


def gates(report: dict) -> dict[str, bool]:
    """Whether each of a release's conditions is met; a time must not exceed its bound."""
    return {k: report[k] <= v if k == "p50" else report[k] >= v for k, v in GATES.items()}


def _table(rows: DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(rows.columns)
    for r in rows.toLocalIterator():
        w.writerow(list(r))
    return "﻿" + out.getvalue()


def write_report(report: dict, predictions: DataFrame, runs: DataFrame, folder: str) -> dict[str, bool]:
    """predictions.csv, performance_runs.csv, report.json and report.md, each whole or not at all; returns the gates."""
    os.makedirs(folder, exist_ok=True)
    met = gates(report)
    for name, rows in (("predictions.csv", predictions), ("performance_runs.csv", runs)):
        atomic_write(os.path.join(folder, name), _table(rows))
    atomic_write(os.path.join(folder, "report.json"), json.dumps({**report, "release_gates": met}, ensure_ascii=False, indent=2))
    lines = [f"- {k}: {v:.4g}" if isinstance(v, float) else f"- {k}: {v}" for k, v in report.items()]
    lines += [f"- {'passed' if ok else 'failed'}: {k}" for k, ok in met.items()]
    atomic_write(os.path.join(folder, "report.md"), "\n".join(["# Blink evaluation", "", *lines]) + "\n")
    return met
