"""Similar pairs: a Hamming join within folders, a cascade of cheaper tests first, and partial rebuilds."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.plans.profiles import Profile, Similarity


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*(F.col(c).alias(f"{x}_{c}") for c in rows.columns)) for x in "ab")


def _bits(key: str, first: int, last: int) -> str:
    return f"shiftrightunsigned({key}, {first}) & {(1 << (last - first)) - 1 if last - first < 64 else -1}L"


def _edges(n: int) -> list[tuple[int, int]]:
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _flips(width: int, most: int) -> list[int]:
    """Masks of at most so many bits."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)]


def _blocks(rows: DataFrame, key: str, n: int, flips: int) -> DataFrame:
    """A row for each of n blocks of the hash's bits and each value within `flips` bits of the block's."""
    parts = [F.expr(f"transform(array({', '.join(f'{m}L' for m in _flips(b - a, flips))}), m -> struct({i} as i, ({_bits(key, a, b)}) ^ m as bits))") for i, (a, b) in enumerate(_edges(n))]
    return rows.withColumn("block", F.explode(F.concat(*parts)))


TILE_ROWS = 4_096


def _tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Rows of a folder dealt over tiles of about tile_rows, once for each pair of tiles (low, high) with their own."""
    sizes = rows.groupBy("dir").agg(F.count("*").alias("rows"))
    n = F.greatest(F.lit(1), F.ceil(F.col("rows") / tile_rows)).cast("int")
    dealt = rows.join(sizes, "dir").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("rows")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return other.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")


def hamming_pairs(rows: DataFrame, s: Similarity, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (a, b), a before b, of one folder whose hashes (phash, dhash as longs) differ within both limits.

    Candidates come from the hash with the smaller radius r. Up to 7 its bits are cut into r + 1 blocks, one of which
    must be equal. Up to 15 four blocks are cut, one of which differs in r // 4 bits at most: either side meets the
    other half way, with the block's values some bits away. Beyond, blocks no longer select and every pair of a folder
    is compared, tile by tile, so that a large folder is spread. Missing hashes are 64 bits from all others.
    """
    key, radius = ("phash", s.phash_max) if s.phash_max <= s.dhash_max else ("dhash", s.dhash_max)
    near = (S.hamming(F.col("a_phash"), F.col("b_phash")) <= s.phash_max) & (S.hamming(F.col("a_dhash"), F.col("b_dhash")) <= s.dhash_max)
    together = (F.col("a_dir") == F.col("b_dir")) & (F.col("a_position") < F.col("b_position")) & near
    if radius <= 15:
        n, least = (radius + 1, 0) if radius <= 7 else (4, radius // 4)
        some = rows.where(F.col(key).isNotNull())
        a, _ = _sides(_blocks(some, key, n, least // 2))
        _, b = _sides(_blocks(some, key, n, least - least // 2))
        pairs = a.join(b, (F.col("a_block") == F.col("b_block")) & together)
        return pairs.drop("a_block", "b_block").dropDuplicates(["a_id", "b_id"])
    a, b = _sides(_tiles(rows, tile_rows))
    meet = (F.col("a_low") == F.col("b_low")) & (F.col("a_high") == F.col("b_high")) & ((F.col("a_own") != F.col("b_own")) | (F.col("a_low") == F.col("a_high")))
    return a.join(b, meet & together).drop(*(f"{x}_{c}" for x in "ab" for c in ("own", "low", "high")))


def _candidates(photos: DataFrame, rows: DataFrame, s: Similarity) -> DataFrame:
    """Pairs near in both hashes: of a whole folder, or only of photos near in number or time."""
    if s.cross_time:
        return hamming_pairs(rows, s)
    a, b = _sides(rows.drop("dir", "position"))
    pairs = nearby_pairs(photos, s).join(a, "a_id").join(b, "b_id")
    near = (S.hamming(F.col("a_phash"), F.col("b_phash")) <= s.phash_max) & (S.hamming(F.col("a_dhash"), F.col("b_dhash")) <= s.dhash_max)
    return pairs.where(near)


def similar_pairs(photos: DataFrame, exact: DataFrame, profile: Profile, ids: DataFrame | None = None) -> DataFrame:
    """Edges between similar photos: aspect, hashes, not joined as exact copies, then structure.

    Vectors stay out of the join: pairs of ids and hashes come first, the vectors of what is left after. Photos
    need dir and position, and sequence and taken where only photos near in number or time are compared; `ids` keeps
    pairs that touch them.
    """
    s = profile.similarity
    rows = photos.select("id", "dir", "position", "phash", "dhash", (F.col("width") / F.greatest(F.lit(1), F.col("height"))).alias("aspect"), S.quality_score(profile.quality).alias("quality"))
    wide = F.greatest("a_aspect", "b_aspect")
    pairs = _candidates(photos, rows, s).where((F.abs(F.col("a_aspect") - F.col("b_aspect")) <= s.aspect_tolerance * wide) & (wide > 0))
    if ids is not None:
        for side in ("a", "b"):
            pairs = pairs.join(ids.select(F.col("id").alias(f"{side}_id"), F.lit(1).alias(f"_{side}")), f"{side}_id", "left")
        pairs = pairs.where("_a is not null or _b is not null").drop("_a", "_b")
    low, high = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    pairs = pairs.join(exact.select(F.col("a_id").alias("x"), F.col("b_id").alias("y")), (low == F.col("x")) & (high == F.col("y")), "left_anti")
    vec = photos.select("id", F.col("structure").alias("v"))
    full = pairs.join(vec.select(F.col("id").alias("a_id"), F.col("v").alias("a_v")), "a_id").join(vec.select(F.col("id").alias("b_id"), F.col("v").alias("b_v")), "b_id")
    scored = full.withColumn("structure", S.correlation(F.col("a_v"), F.col("b_v"))).where(F.col("structure") >= s.structure_min)
    hashes = 0.45 * (1 - S.hamming(F.col("a_phash"), F.col("b_phash")) / 64) + 0.25 * (1 - S.hamming(F.col("a_dhash"), F.col("b_dhash")) / 64)
    better = F.when(F.col("a_quality") >= F.col("b_quality"), F.col("a_id")).otherwise(F.col("b_id"))
    return scored.select(low.alias("a_id"), high.alias("b_id"), (hashes + 0.30 * F.col("structure")).alias("score"), F.lit("similar").alias("kind"), better.alias("recommended_id"))


UNNUMBERED = 999_999


def nearby_pairs(rows: DataFrame, s: Similarity) -> DataFrame:
    """(a_id, b_id): each photo with the unbroken run of following ones near it in number or time.

    rows: id, dir, position, sequence (-1 unknown), taken. Positions ascend with the number, so a run ends at the
    first photo that is neither within the gap nor the window. Photos meet by ranges of numbers as wide as the gap, or
    of time as wide as the window, their own and the next ones: pairs that are near in neither way never meet.
    """
    rows = rows.select("id", "dir", "position", "sequence", F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', cast(taken as timestamp_ntz))").alias("at"))
    a, b = _sides(rows)
    apart = F.abs(F.col("a_sequence") - F.col("b_sequence"))
    numbered = F.coalesce(F.when((F.col("a_sequence") >= 0) & (F.col("b_sequence") >= 0), apart <= s.sequence_gap), F.lit(s.sequence_gap >= UNNUMBERED))
    timed = F.abs(F.col("a_at") - F.col("b_at")) / 60e6 <= s.time_window_min
    after = (F.col("a_dir") == F.col("b_dir")) & (F.col("b_position") > F.col("a_position"))
    if s.sequence_gap >= UNNUMBERED:  # unnumbered photos are near all
        pairs = a.join(b, after & (numbered | F.coalesce(timed, F.lit(False))))
    else:
        wide, long = max(1, int(s.sequence_gap)), max(1, math.ceil(s.time_window_min * 60e6))
        place = F.floor(F.col("a_sequence") / wide)
        by_number = a.where("a_sequence >= 0").withColumn("a_range", F.explode(F.array(place, place + 1)))
        by_number = by_number.join(b.withColumn("b_range", F.floor(F.col("b_sequence") / wide)), after & (F.col("a_range") == F.col("b_range")) & numbered)
        turn = F.floor(F.col("a_at") / long)
        by_time = a.where("a_at is not null").withColumn("a_range", F.explode(F.array(turn - 1, turn, turn + 1)))
        by_time = by_time.join(b.withColumn("b_range", F.floor(F.col("b_at") / long)), after & (F.col("a_range") == F.col("b_range")) & timed & ~numbered)
        pairs = by_number.unionByName(by_time)
    # the run is unbroken exactly while as many partners are near as positions have passed
    run = W.partitionBy("a_id").orderBy("b_position")
    return pairs.withColumn("n", F.row_number().over(run)).where(F.col("b_position") - F.col("a_position") == F.col("n")).select("a_id", "b_id")


def insert_new(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges with those of `more` whose pair is not there."""
    fresh = more.dropDuplicates(["a_id", "b_id"]).join(edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    return edges.unionByName(fresh)


def replace_partial(edges: DataFrame, rebuilt: DataFrame, ids: DataFrame) -> DataFrame:
    """edges without the similar ones that touch ids, and the rebuilt ones where their pair is free."""
    similar = edges.where("kind = 'similar'")
    for side in ("a_id", "b_id"):
        similar = similar.join(ids.select(F.col("id").alias(side)), side, "left_anti")
    return insert_new(edges.where("kind <> 'similar'").unionByName(similar.select(edges.columns)), rebuilt)


def neighbourhood(edges: DataFrame, ids: DataFrame, kind: str = "similar") -> DataFrame:
    """(id): ids and what one edge of the kind joins them to."""
    e = edges.where(F.col("kind") == kind)
    there = e.join(ids.select(F.col("id").alias("a_id")), "a_id", "left_semi").select(F.col("b_id").alias("id"))
    back = e.join(ids.select(F.col("id").alias("b_id")), "b_id", "left_semi").select(F.col("a_id").alias("id"))
    return ids.select("id").union(there).union(back).distinct()


def active_edges(edges: DataFrame, photos: DataFrame) -> DataFrame:
    """Edges whose ends are both active."""
    live = photos.where("status = 'active'").select("id")
    return edges.join(live.select(F.col("id").alias("a_id")), "a_id", "left_semi").join(live.select(F.col("id").alias("b_id")), "b_id", "left_semi")


def near(a: Column, b: Column, radius: int) -> Column:
    return S.hamming(a, b) <= radius
