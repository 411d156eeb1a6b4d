"""Decisions, scans against stored rows, quarantine plans: every mutation gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.operators.graph import written


def mark_ai_removals(photos: DataFrame) -> DataFrame:
    """Undecided photos suggested for removal become decided, and `changed` says which."""
    hit = F.coalesce((F.col("status") == "active") & (F.coalesce(F.col("error"), F.lit("")) == "") & (F.col("suggestion") == "remove") & (F.col("decision") == ""), F.lit(False))
    return photos.withColumns({"changed": hit, "decision": F.when(hit, "remove").otherwise(F.col("decision"))})


def clear(photos: DataFrame) -> DataFrame:
    hit = F.coalesce((F.col("status") == "active") & (F.col("decision") != ""), F.lit(False))
    return photos.withColumns({"changed": hit, "decision": F.when(hit, "").otherwise(F.col("decision"))})


def latest(log: DataFrame) -> DataFrame:
    """(id, decision): the last entry (id, at, decision) of each photo."""
    return log.groupBy("id").agg(F.max_by("decision", "at").alias("decision"))


def decide(photos: DataFrame, log: DataFrame) -> DataFrame:
    """photos with the latest logged decision; only active ones take it."""
    d = latest(log).withColumnRenamed("decision", "_new")
    out = photos.join(d, "id", "left")
    took = (F.col("status") == "active") & F.col("_new").isNotNull()
    return out.withColumn("decision", F.when(took, F.col("_new")).otherwise(F.col("decision"))).select(*photos.columns)


def refused(photos: DataFrame, log: DataFrame) -> DataFrame:
    """(id): photos that the log decides on and that are not there or not active."""
    return log.select("id").distinct().join(photos.where("status = 'active'").select("id"), "id", "left_anti")


def import_decisions(photos: DataFrame, rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """photos after the rows (line, path, decision), and one row of how many were found and not.

    Rows other than keep or remove, as they are written, count for nothing. A path matches as it is, else without
    the root's name before it; of rows for one photo the last wins.
    """
    path = F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/")
    short = F.when(F.startswith(path, F.lit(f"{root}/")), F.substr(path, F.lit(len(root) + 2)))
    named = F.posexplode(F.array_compact(F.array(path, short))).alias("order", "relative_path")
    asked = rows.where(F.col("decision").isin("keep", "remove")).select("line", F.col("decision").alias("_new"), named)
    found = asked.join(photos.select("id", "relative_path"), "relative_path").groupBy("line").agg(F.min_by(F.struct("id", "_new"), "order").alias("hit")).select("line", "hit.id", F.col("hit._new"))
    last = found.groupBy("id").agg(F.max_by("_new", "line").alias("_new"))
    out = photos.join(last, "id", "left").withColumn("decision", F.coalesce("_new", "decision")).select(*photos.columns)
    totals = asked.select("line").distinct().join(found.select("line", F.lit(1).alias("hit")), "line", "left").agg(F.count("hit").alias("imported"), (F.count("*") - F.count("hit")).alias("missing"))
    return out, totals


def export_rows(photos: DataFrame) -> DataFrame:
    return photos.where("decision <> ''").select("decision", "relative_path", "suggestion", "reason").orderBy("relative_path")


def motion_same() -> Column:
    pairs = [F.col(f"old_{c}") == F.col(c) for c in ("media_type", "motion_kind", "motion_relative_path", "motion_offset", "motion_length", "motion_size")]
    out = F.abs(F.col("old_motion_mtime") - F.col("motion_mtime")) < 0.001
    for p in pairs:
        out = out & p
    return out


def scan_diff(listing: DataFrame, stored: DataFrame, motion: bool = False) -> DataFrame:
    """(relative_path, id, action) of a fresh listing (relative_path, size, mtime) against stored rows.

    new, reanalyse, reuse, reactivate (reusable but not active), missing (stored active, not listed).
    """
    own = ["relative_path", "id", "size", "mtime", "status", "error", "thumbnail"]
    extra = ["media_type", "motion_kind", "motion_relative_path", "motion_offset", "motion_length", "motion_size", "motion_mtime", "motion_error", "motion_still_time_ms"] if motion else []
    old = stored.select("relative_path", *(F.col(c).alias(f"old_{c}") for c in [*own[1:], *extra]))
    both = listing.withColumn("_here", F.lit(True)).join(old, "relative_path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.abs(F.col("mtime") - F.col("old_mtime")) < 0.001) & (F.coalesce("old_error", F.lit("")) == "") & (F.coalesce("old_thumbnail", F.lit("")) != "")
    if motion:
        same = same & motion_same() & (F.coalesce("old_motion_error", F.lit("")) == "") & ((F.col("old_media_type") != "motion_photo") | (F.coalesce("old_motion_still_time_ms", F.lit(-1)) >= 0))
    same = F.coalesce(same, F.lit(False))
    action = F.when(F.col("_here").isNull(), F.when(F.col("old_status") == "active", "missing")).when(F.col("old_id").isNull(), "new").when(~same, "reanalyse").when(F.col("old_status") == "active", "reuse").otherwise("reactivate")
    return both.select("relative_path", F.col("old_id").alias("id"), action.alias("action")).where("action is not null")


def after_scan(stored: DataFrame, diff: DataFrame) -> DataFrame:
    """stored with what was not listed missing, and what came back active."""
    return stored.join(diff.select("relative_path", "action"), "relative_path", "left").withColumn("status", F.when(F.col("action") == "missing", "missing").when(F.col("action").isin("reactivate", "reanalyse"), "active").otherwise(F.col("status"))).select(*stored.columns)


# The marks of a motion photo in its metadata.
_MARK = r"""(?i)(?:GCamera|Camera|Samsung):(?:MotionPhoto|MicroVideo)\s*=\s*["']1["']"""
_OFFSET = r"""(?i)(?:MicroVideoOffset|MotionPhotoOffset)\s*=\s*["'](\d+)["']"""
_ITEM = r"""(?i)<[^>]*Semantic\s*=\s*["']MotionPhoto["'][^>]*>"""
_LENGTH = r"""(?i)Length\s*=\s*["'](\d+)["']"""
_TIME = r"""(?i)(?:GCamera|Camera):(?:MotionPhoto|MicroVideo)PresentationTimestampUs\s*=\s*["'](-?\d+)["']"""


def embedded_motion(path: Column, head: Column, size: Column) -> Column:
    """The clip that a photo carries behind itself, by the metadata in its head: struct (offset, length, timestamp_us) or null.

    Only JPEG files whose metadata marks them; the length is that of the marked offset, else of the first item with
    the motion photo's meaning that has one, and must leave a photo before it.
    """
    def number(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")

    items = F.transform(F.regexp_extract_all(head, F.lit(_ITEM), F.lit(0)), lambda x: number(x, _LENGTH))
    length = F.coalesce(F.nullif(number(head, _OFFSET), F.lit(0)), F.get(F.filter(items, lambda n: n.isNotNull()), F.lit(0)))
    fits = F.lower(path).rlike(r"\.jpe?g$") & F.regexp_like(head, F.lit(_MARK)) & (length > 0) & (length < size)
    found = F.struct((size - length).alias("offset"), length.alias("length"), F.coalesce(number(head, _TIME), F.lit(-1)).alias("timestamp_us"))
    return F.when(fits, found)


def sidecars(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Images (id, relative_path, embedded) with the motion they carry: embedded, else a video of their folder and stem.

    Of several such videos the last in the order of discovery counts: the largest path.
    """
    def keyed(df: DataFrame) -> DataFrame:
        folder = F.when(F.contains("relative_path", F.lit("/")), F.regexp_replace("relative_path", "/[^/]*$", "")).otherwise("")
        return df.withColumns({"_dir": folder, "_stem": F.lower(F.regexp_extract("relative_path", r"([^/]*?)(\.[^./]*)?$", 1))})

    clips = keyed(videos.where(F.lower("relative_path").rlike(r"\.(mov|m4v|mp4)$"))).groupBy("_dir", "_stem").agg(F.max("relative_path").alias("clip"))
    kind = F.when(F.col("embedded"), "android_embedded").when(F.col("clip").isNotNull(), "apple_sidecar").otherwise("")
    rows = keyed(images).join(clips, ["_dir", "_stem"], "left")
    path = F.when(F.col("embedded"), F.col("relative_path")).otherwise(F.coalesce("clip", F.lit("")))
    return rows.select("id", "relative_path", kind.alias("motion_kind"), path.alias("motion_relative_path"))


def unsupported(files: DataFrame, supported: list[str], paired: DataFrame) -> DataFrame:
    """(ext, n) of files (relative_path, ext) that are neither photos nor paired clips."""
    return files.where(~F.col("ext").isin(*supported)).join(paired.select(F.col("motion_relative_path").alias("relative_path")), "relative_path", "left_anti").groupBy("ext").agg(F.count("*").alias("n"))


def _clip_apart() -> Column:
    own = (F.col("motion_kind") == "apple_sidecar") & (F.col("motion_relative_path") != F.col("relative_path")) & (F.col("motion_relative_path") != "")
    return F.coalesce(own, F.lit(False))


def _moving() -> Column:
    return F.coalesce("size", F.lit(0)) + F.when(_clip_apart(), F.coalesce("motion_size", F.lit(0))).otherwise(0)


def quarantine_preview(photos: DataFrame) -> DataFrame:
    """One row: how many photos would move and their bytes, clips included."""
    return photos.where("decision = 'remove' and status = 'active'").agg(F.count("*").alias("count"), F.coalesce(F.sum(_moving()), F.lit(0)).cast("long").alias("total_size"))


MTIME_SLACK = 0.010


def quarantine_plan(photos: DataFrame, listing: DataFrame, batch: str) -> DataFrame:
    """The batch's manifest: move, missing or changed, by a fresh listing (relative_path, size, mtime) of photos and clips.

    Where photos have motion columns, a clip of its own is held against the listing too: its size, and its time
    where one is stored. A photo and its clip move together or not at all.
    """
    rows = photos.where("decision = 'remove' and status = 'active'")
    now = listing.select("relative_path", F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"))
    gone = F.col("now_size").isNull()
    other = (F.col("now_size") != F.col("size")) | (F.abs(F.col("now_mtime") - F.col("mtime")) > MTIME_SLACK)
    found = rows.join(now, "relative_path", "left")
    if {"motion_kind", "motion_relative_path", "motion_size"} <= set(photos.columns):
        clip = listing.select(F.col("relative_path").alias("_clip"), F.col("size").alias("clip_size"), F.col("mtime").alias("clip_mtime"))
        found = found.withColumn("_apart", _clip_apart())
        found = found.join(clip, F.col("_apart") & (F.col("motion_relative_path") == F.col("_clip")), "left")
        changed = F.coalesce(F.col("clip_size") != F.coalesce("motion_size", F.lit(0)), F.lit(False))
        if "motion_mtime" in photos.columns:
            changed = changed | F.coalesce(F.abs(F.col("clip_mtime") - F.col("motion_mtime")) > MTIME_SLACK, F.lit(False))
        gone, other = gone | (F.col("_apart") & F.col("clip_size").isNull()), other | (F.col("_apart") & changed)
    state = F.when(gone, "missing").when(other, "changed").otherwise("move")
    return found.select("id", "relative_path", "size", state.alias("state"), F.concat(F.lit(f"{batch}/"), "relative_path").alias("target")).orderBy("relative_path")


def batch_totals(manifest: DataFrame) -> DataFrame:
    moved = F.col("state") == "move"
    return manifest.agg(F.count_if(moved).alias("moved"), F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).cast("long").alias("moved_bytes"), F.count_if(~moved).alias("skipped"))


def batches_newest_first(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.desc("created_at"), F.desc("id"))


MOST_RECENT = 12


def recents(opened: DataFrame) -> DataFrame:
    """The projects (project_id, at) opened last, each once, MOST_RECENT at most."""
    return opened.groupBy("project_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "project_id").limit(MOST_RECENT)


def restore_plan(manifest: DataFrame, taken: DataFrame) -> DataFrame:
    """Where moved photos go back to: their path, or the first numbered variant of it that no file has."""
    stem = F.regexp_replace("relative_path", r"(\.[^./]*)?$", "")
    parts = {"_stem": stem, "_suffix": F.regexp_extract("relative_path", r"(\.[^./]*)$", 1)}
    rows = manifest.where("state in ('move', 'moved', 'restoring')").withColumns(parts)
    # the variants that files have, by the path they are variants of
    mark = r" \(restored(?: ([0-9]+))?\)(\.[^./]*)?$"
    number = F.when(F.regexp_like("relative_path", F.lit(mark)), F.coalesce(F.nullif(F.regexp_extract("relative_path", mark, 1), F.lit("")).try_cast("int"), F.lit(1))).otherwise(0)
    every = taken.select("relative_path").distinct()
    own = every.select("relative_path", F.lit(0).alias("n"))
    more = every.select(F.regexp_replace("relative_path", mark, "$2").alias("relative_path"), number.alias("n")).where("n > 0")
    used = own.union(more).groupBy("relative_path").agg(F.collect_set("n").alias("used"))
    found = rows.join(used, "relative_path", "left")
    conflict = F.coalesce(F.array_contains("used", 0), F.lit(False))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), "used"))
    name = F.concat("_stem", F.lit(" (restored"), F.when(free > 1, F.concat(F.lit(" "), free.cast("string"))).otherwise(""), F.lit(")"), "_suffix")
    return found.select("id", "relative_path", F.when(conflict, name).otherwise(F.col("relative_path")).alias("back_to"), conflict.alias("conflict"))


def upsert(stored: DataFrame, fresh: DataFrame, keep: tuple[str, ...] = ("id", "decision")) -> DataFrame:
    """stored with the analysis columns of fresh rows of the same path; `keep` stays, new rows get ids by path."""
    cols = [c for c in stored.columns if c not in keep and c != "relative_path" and c in fresh.columns]
    new = fresh.select("relative_path", F.lit(True).alias("_fresh"), *(F.col(c).alias(f"_{c}") for c in cols))
    both = stored.withColumn("_stored", F.lit(True)).join(new, "relative_path", "full_outer")
    pick = {c: F.when(F.col("_fresh"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    out = written(both.withColumns({**pick, "decision": F.coalesce("decision", F.lit(""))}).select("_stored", *stored.columns), "upsert")
    known = out.where("_stored").select(*stored.columns)
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    added = numbered(out.where("_stored is null").select(*(c for c in stored.columns if c != "id")), "relative_path")
    added = added.withColumn("id", (F.lit(top) + F.col("n")).cast(stored.schema["id"].dataType))
    return known.unionByName(added.select(*stored.columns))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with `n` from 1 in the order of a column, without one task for all.

    Ranges are numbered and written, once: their bounds come from a sample, and another run could draw them elsewhere.
    What precedes a range is added from that table.
    """
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by)
    local = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # the partition, and from bit 33 down the place in it
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    before = {r["part"]: r["n"] for r in local.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    shift, total = [], 0
    for p in sorted(before):
        shift += [F.lit(p), F.lit(total).cast("long")]
        total += before[p]
    return local.withColumn("n", place + F.create_map(*shift)[part] if shift else place).drop("_at")
