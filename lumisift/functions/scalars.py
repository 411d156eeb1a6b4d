"""Column functions: hashes, scores, names and times of photos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumisift.plans.profiles import Quality


def hash_bits(hex16: Column) -> Column:
    """The 64 bits of 16 hex digits as a signed long; an empty text gives null."""
    return F.conv(F.nullif(hex16, F.lit("")), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 where a hash is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def correlation(a: Column, b: Column) -> Column:
    """Cosine of two mean-centred vectors; 0 where one is missing or flat."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def centred(v: Column) -> Column:
    # the mean as an argument, not inside the lambda, which would sum the array anew for each element
    return F.zip_with(v, F.array_repeat(mean(v), F.size(v)), lambda x, m: x - m)


def standardised(v: Column) -> Column:
    """Centred, over a population deviation of at least 1."""
    c = centred(v)
    dev = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(v))
    return F.zip_with(c, F.array_repeat(F.greatest(dev, F.lit(1.0)), F.size(v)), lambda x, d: x / d)


def quality_score(q: Quality) -> Column:
    """Weighted sum of sharpness, exposure, contrast, entropy and resolution; luminance 0 or null counts as 128."""
    w = dict(q.weights)

    def part(c: str, whole: float) -> Column:
        return F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / whole)

    lum = F.coalesce(F.nullif(F.col("luminance").cast("double"), F.lit(0.0)), F.lit(128.0))
    off = F.abs(lum - 110) / 140 + F.coalesce(F.col("dark_clip"), F.lit(0.0)) + F.coalesce(F.col("bright_clip"), F.lit(0.0))
    sharp = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("sharpness"), F.lit(0.0)))) / 10
    exposure = F.lit(1.0) - F.least(F.lit(1.0), off)
    return sharp * w["sharpness"] + exposure * w["exposure"] + part("contrast", 70) * w["contrast"] + part("entropy", 8) * w["entropy"] + part("megapixels", 12) * w["resolution"]


def display_score(score: Column) -> Column:
    """0 to 100 to one decimal, half to even; null for unreadable photos."""
    return F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100, 1))


def sequence_number(path: Column) -> Column:
    """The last run of digits in a file's name, its extension included; -1 without."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)(?!.*\d)", 1), F.lit("")).try_cast("long"), F.lit(-1).cast("long"))


def capture_time(taken: Column) -> Column:
    """The first 19 characters by either of the two layouts, or null."""
    t = F.substring(taken, 1, 19)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


def directory(path: Column) -> Column:
    """Lower-cased parent folder; '.' for the root."""
    return F.when(F.contains(path, F.lit("/")), F.lower(F.regexp_replace(path, r"/[^/]*$", ""))).otherwise(F.lit("."))


def shooting_key(taken: Column, seq: Column, path: Column) -> Column:
    """Timed photos by time, then others; unnumbered ones last among equals."""
    return F.struct(taken.isNull().alias("untimed"), taken.alias("taken"), F.when(seq < 0, F.lit((1 << 63) - 1)).otherwise(seq).alias("seq"), F.lower(path).alias("path"))


def project_id(root: Column) -> Column:
    return F.substring(F.sha1(F.lower(root)), 1, 16)


def thumbnail_name(path: Column, revision: Column | None = None) -> Column:
    mark = F.lit("") if revision is None else F.when(revision > 0, F.concat(F.lit(".cover-"), revision.cast("string"))).otherwise("")
    return F.concat(F.sha1(path), mark, F.lit(".jpg"))


def thumbnail_path(name: Column) -> Column:
    return F.concat(F.lit("thumbs/"), F.element_at(F.split(name, r"[\\/]"), -1))


def motion_fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 20)


def blink_fingerprint(**parts: Column) -> Column:
    """SHA-256 of the inputs as JSON with sorted keys and without blanks; a null input is written as null."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def group_id(ids: Column) -> Column:
    return F.concat(F.lit("sg-"), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")), 1, 16))
