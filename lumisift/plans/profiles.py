"""Query parameters: the three built-in profiles, their validation, and the plan for a change of profile."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

# The rules, the three built-in profiles with their thresholds and weights, and the ranges allowed.
RULES = ("sharpness", "luminance", "bright_clip", "contrast", "entropy", "resolution", "file_size")


@dataclass(frozen=True)
class Quality:
    blur_review: float = 260
    blur_remove: float = 120
    blur_percentile_review: float = 15
    blur_percentile_remove: float = 6
    dark_review: float = 38
    dark_remove: float = 22
    dark_clip_review: float = 0.55
    dark_clip_remove: float = 0.72
    bright_clip_review: float = 0.18
    bright_clip_remove: float = 0.42
    contrast_review: float = 28
    contrast_remove: float = 18.2
    entropy_review: float = 4.8
    entropy_remove: float = 3.8
    megapixels_review: float = 0.5
    megapixels_remove: float = 0.1
    size_kb_review: float = 20
    size_kb_remove: float = 1
    threshold_mode: str = "absolute"
    match_mode: str = "any"
    enabled: tuple[str, ...] = RULES
    weights: tuple[tuple[str, float], ...] = (("sharpness", 0.45), ("exposure", 0.25), ("contrast", 0.12), ("entropy", 0.10), ("resolution", 0.08))


@dataclass(frozen=True)
class Blink:
    closed_min: float = 0.85
    open_min: float = 0.80
    face_min: float = 0.80
    eye_distance_min: int = 12
    coverage_min: float = 0.80


@dataclass(frozen=True)
class Similarity:
    phash_max: int = 11
    dhash_max: int = 10
    structure_min: float = 0.80
    aspect_tolerance: float = 0.11
    time_window_min: float = 45
    sequence_gap: int = 50
    min_group_size: int = 2
    cross_time: bool = True
    face_safe: bool = True
    blink: Blink = field(default_factory=Blink)


@dataclass(frozen=True)
class Profile:
    quality: Quality = field(default_factory=Quality)
    similarity: Similarity = field(default_factory=Similarity)


BALANCED = Profile()
CONSERVATIVE = Profile(
    Quality(blur_review=150, blur_remove=70, blur_percentile_review=8, blur_percentile_remove=3, dark_review=28, dark_remove=14, bright_clip_review=0.28, bright_clip_remove=0.60, contrast_review=22, contrast_remove=14.3),
    Similarity(phash_max=6, dhash_max=6, structure_min=0.90, aspect_tolerance=0.08, time_window_min=20, sequence_gap=25),
)
AGGRESSIVE = Profile(
    Quality(blur_review=420, blur_remove=190, blur_percentile_review=25, blur_percentile_remove=10, dark_review=50, dark_remove=30, bright_clip_review=0.10, bright_clip_remove=0.28, contrast_review=36, contrast_remove=23.4),
    Similarity(phash_max=16, dhash_max=14, structure_min=0.68, aspect_tolerance=0.15, time_window_min=90, sequence_gap=90),
)
BUILT_IN = {"conservative": CONSERVATIVE, "balanced": BALANCED, "aggressive": AGGRESSIVE}


WEIGHTS = ("sharpness", "exposure", "contrast", "entropy", "resolution")
RANGES = {
    "blur_review": (0, 10_000),
    "blur_remove": (0, 10_000),
    "dark_review": (0, 255),
    "dark_remove": (0, 255),
    "contrast_review": (0, 128),
    "contrast_remove": (0, 128),
    "entropy_review": (0, 8),
    "entropy_remove": (0, 8),
    "megapixels_review": (0, 500),
    "megapixels_remove": (0, 500),
    "size_kb_review": (0, 10_000_000),
    "size_kb_remove": (0, 10_000_000),
    "time_window_min": (0, 10_080),
    "sequence_gap": (0, 10_000),
    "min_group_size": (2, 1_000),
    "structure_min": (-1, 1),
    "closed_min": (0.5, 0.99),
    "open_min": (0.5, 0.99),
    "face_min": (0.5, 0.99),
    "eye_distance_min": (4, 64),
    "coverage_min": (0.5, 1),
}
SIGNED = {"structure_min"}


def _numbers(p: Profile) -> Iterator[tuple[str, object]]:
    for part in (p.quality, p.similarity, p.similarity.blink):
        for name, value in asdict(part).items():
            if name not in {"threshold_mode", "match_mode", "enabled", "weights", "cross_time", "face_safe", "blink"}:
                yield name, value


def _misfits(p: Profile) -> list[str]:
    """Values of a wrong type or out of their range."""
    wrong = []
    for name, value in _numbers(p):
        low, high = RANGES.get(name, (0, math.inf))
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            wrong.append(f"{name} must be a number")
        elif not math.isfinite(value) or value < 0 and name not in SIGNED:
            wrong.append(f"{name} must be finite and not negative")
        elif not low <= value <= high:
            wrong.append(f"{name} must lie between {low} and {high}")
    weights = dict(p.quality.weights)
    for name in WEIGHTS:
        x = weights.get(name)
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 10:
            wrong.append(f"the weight of {name} must be a number between 0 and 10")
    if not wrong and sum(weights[n] for n in WEIGHTS) <= 0:
        wrong.append("the weights must not all be 0")
    for name in ("cross_time", "face_safe"):
        if not isinstance(getattr(p.similarity, name), bool):
            wrong.append(f"{name} must be true or false")
    if not isinstance(p.similarity.blink.eye_distance_min, int):
        wrong.append("eye_distance_min must be a whole number")
    return wrong


def validate_name(name: str) -> list[str]:
    """What is wrong with a profile's name."""
    return [] if 1 <= len(name.strip()) <= 40 else ["a profile's name has 1 to 40 characters"]


def validate(p: Profile) -> list[str]:
    """What is wrong with a profile."""
    wrong = _misfits(p)
    if wrong:
        return wrong
    if p.similarity.blink.open_min + p.similarity.blink.closed_min <= 1:
        wrong.append("open_min and closed_min must be more than 1 together")
    q, s = p.quality, p.similarity
    for low in ("blur", "blur_percentile", "dark", "contrast", "entropy", "megapixels", "size_kb"):
        if getattr(q, f"{low}_remove") > getattr(q, f"{low}_review"):
            wrong.append(f"{low}_remove must not exceed {low}_review")
    for high in ("dark_clip", "bright_clip"):
        if getattr(q, f"{high}_remove") < getattr(q, f"{high}_review"):
            wrong.append(f"{high}_remove must not be below {high}_review")
        wrong += [f"{high}_{k} must be at most 1" for k in ("review", "remove") if getattr(q, f"{high}_{k}") > 1]
    wrong += [f"blur_percentile_{k} must be at most 100" for k in ("review", "remove") if getattr(q, f"blur_percentile_{k}") > 100]
    if q.threshold_mode not in {"absolute", "percentile"}:
        wrong.append("threshold_mode must be absolute or percentile")
    if q.match_mode not in {"any", "all"}:
        wrong.append("match_mode must be any or all")
    wrong += [f"unknown rule {r}" for r in q.enabled if r not in RULES]
    wrong += [f"{n} must be at most 64" for n in ("phash_max", "dhash_max") if getattr(s, n) > 64]
    wrong += [f"{n} must be at most 1" for n in ("structure_min", "aspect_tolerance") if getattr(s, n) > 1]
    return wrong


@dataclass(frozen=True)
class RefreshPlan:
    reclassify: bool
    rebuild: bool
    blinks: bool
    ids: frozenset[int] | None = None


def change_plan(old: Profile, new: Profile) -> RefreshPlan:
    """Which stages a change of profile makes stale."""
    pairs = replace(old.similarity, blink=Blink()) != replace(new.similarity, blink=Blink())
    return RefreshPlan(old.quality != new.quality, pairs, pairs or old.similarity.blink != new.similarity.blink)


def blink_thresholds(b: Blink) -> str:
    """The thresholds as JSON with sorted keys, a part of each photo's blink fingerprint."""
    named = {
        "face_confidence_min": float(b.face_min),
        "open_confidence_min": float(b.open_min),
        "closed_confidence_min": float(b.closed_min),
        "min_eye_distance_px": b.eye_distance_min,
        "reliable_coverage_min": float(b.coverage_min),
    }
    return json.dumps(named, sort_keys=True, separators=(",", ":"))


def fingerprint(p: Profile, blinks: bool) -> str:
    """SHA-256 of a profile and whether blinks count: what a group topology depends on beside the rows."""
    return hashlib.sha256(json.dumps({"profile": asdict(p), "blinks": blinks}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def photo_plan(photo_id: int) -> RefreshPlan:
    """All stages for one changed photo."""
    return RefreshPlan(True, True, True, frozenset({photo_id}))


def filter_set(spec: str | None, allowed: tuple[str, ...]) -> frozenset[str]:
    """The values a filter names: all, none, or a comma-separated list."""
    if spec is None or spec.strip() == "all":
        return frozenset(allowed)
    if spec.strip() == "none":
        return frozenset()
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts:
        raise ValueError("an empty filter names nothing; say all or none")
    if unknown := sorted(set(parts) - set(allowed)):
        raise ValueError(f"unknown filter value {unknown[0]!r}")
    return frozenset(parts)
