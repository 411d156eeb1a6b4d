"""Library queries: filters, counts, search, order and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.plans.profiles import Profile, filter_set

DECISIONS = ("undecided", "keep", "remove")
AI = ("remove", "review", "no_suggestion")
PRESETS = {"library": ("all", "all"), "ai": ("undecided", "remove,review"), "undecided": ("undecided", "all"), "keep": ("keep", "all"), "remove": ("remove", "all")}


def readable() -> Column:
    return (F.coalesce(F.col("error"), F.lit("")) == "") & (F.col("suggestion") != "unreadable")


def library_filter(decisions: str | None = None, ai: str | None = None, unreadable: bool = False) -> Column:
    """Active photos, readable or not, of the decisions and suggestions named."""
    picks = []
    for spec, allowed, column, named in ((decisions, DECISIONS, "decision", {"undecided": ""}), (ai, AI, "suggestion", {"no_suggestion": "keep"})):
        chosen = filter_set(spec, allowed)
        if not chosen:
            picks.append(F.lit(False))
        elif len(chosen) < len(allowed):
            picks.append(F.col(column).isin(sorted(named.get(c, c) for c in chosen)))
    state = (F.coalesce(F.col("error"), F.lit("")) != "") | (F.col("suggestion") == "unreadable") if unreadable else readable()
    return reduce(lambda a, b: a & b, picks, (F.col("status") == "active") & state)


def page(photos: DataFrame, where: Column, search: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
    """One page in library order."""
    found = photos.where(where)
    if search:
        found = found.where(F.col("relative_path").ilike(f"%{search}%"))
    rank = F.expr("case suggestion when 'remove' then 0 when 'review' then 1 when 'unreadable' then 2 else 3 end")
    return found.orderBy(rank, "relative_path").offset(max(0, offset)).limit(min(500, max(1, limit)))


def _whole(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def payload(photos: DataFrame, profile: Profile, project_id: str, token: str = "") -> DataFrame:
    """What a client sees: score from 0 to 100, sentinels as null, links with the cover's revision, motion fields nested."""
    def link(path: str) -> Column:
        return F.concat(F.lit(f"/api/{path}?project_id={project_id}&id="), F.col("id").cast("string"), F.lit(f"&token={token}&v="), _whole("cover_revision").cast("string"))

    whole = ("duration_ms", "frame_count", "width", "height", "still_time_ms")
    fields = [F.col("motion_kind").alias("kind"), *(_whole(f"motion_{c}").alias(c) for c in whole), F.coalesce("motion_fps", F.lit(0)).cast("double").alias("fps")]
    fields += ["cover_source", _whole("cover_time_ms").alias("cover_time_ms"), _whole("cover_frame_index").alias("cover_frame_index"), F.col("motion_error").alias("error"), link("motion/video").alias("video_url")]
    return photos.withColumns({
        "project_id": F.lit(project_id),
        "quality_score": S.display_score(S.quality_score(profile.quality)),
        "blink_closed_ratio": F.when(F.col("blink_closed_ratio") >= 0, F.col("blink_closed_ratio")),
        "thumb_url": link("thumb"),
        "photo_url": link("photo"),
        "motion": F.when(F.col("media_type") == "motion_photo", F.struct(*fields)),
    })


SUGGESTIONS = ("remove", "review", "keep", "unreadable")


def counts(photos: DataFrame) -> DataFrame:
    """Every count of the project page in one pass."""
    active, ok = F.col("status") == "active", readable()
    act = {"total": active, **{f"ai_{s}": active & (F.col("suggestion") == s) for s in ("keep", "review", "remove")}, "unreadable": library_filter(unreadable=True)}
    act |= {f"decision_{d or 'undecided'}": active & (F.col("decision") == d) for d in ("", "keep", "remove")}
    act |= {"readable": active & ok} | {f"library_{name}": library_filter(*spec) for name, spec in PRESETS.items() if name != "library"}
    act |= {"ai_remove_pending": library_filter("undecided", "remove"), "ai_unreadable": active & (F.col("suggestion") == "unreadable")}
    return photos.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in act.items()))


def project_counts(photos: DataFrame) -> DataFrame:
    """One row: total, and counts by suggestion and by decision as maps without zeros."""
    n = counts(photos)

    def some(names: tuple[str, ...], prefix: str) -> Column:
        pairs = F.create_map(*(x for k in names for x in (F.lit(k), F.col(f"{prefix}_{k}"))))
        return F.map_filter(pairs, lambda _, v: v > 0)

    return n.select("total", some(SUGGESTIONS, "ai").alias("counts"), some(("keep", "remove"), "decision").alias("decisions"))


def recent_project(photos: DataFrame) -> DataFrame:
    """Active photos, those kept, and the cover: kept first, then newest, then highest id."""
    active = photos.where("status = 'active'")
    sums = active.agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "keep").alias("kept"))
    cover = active.where("error = '' and thumbnail <> ''").orderBy(F.when(F.col("decision") == "keep", 0).otherwise(1), F.desc("mtime"), F.desc("id")).limit(1).select(F.col("id").alias("cover_id"))
    return sums.join(F.broadcast(cover), how="left")  # one row each
