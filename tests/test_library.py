"""Semantics that the registered queries do not reach, and every query against its SQL."""

from __future__ import annotations

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import dedupe, faces, groups, library, quality, raster, similarity
from lumisift.plans import profiles as P
from lumisift.plans.more import ORACLE_SQL, QUERIES
from lumisift.sources import files, moves

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_hashes_above_the_signed_range(spark):
    assert one(spark, S.hash_bits(F.lit("f" * 16))) == -1
    assert one(spark, S.hash_bits(F.lit(""))) is None
    assert one(spark, S.hamming(S.hash_bits(F.lit("f" * 16)), S.hash_bits(F.lit("0" * 16)))) == 64
    assert one(spark, S.hamming(S.hash_bits(F.lit("")), S.hash_bits(F.lit("0" * 16)))) == 64


def test_luminance_zero_scores_as_128(spark):
    v = dict(sharpness=900.0, luminance=0.0, contrast=60.0, dark_clip=0.01, bright_clip=0.01, entropy=7.0, megapixels=12.0)
    assert one(spark, S.quality_score(P.BALANCED.quality), **v) == pytest.approx(one(spark, S.quality_score(P.BALANCED.quality), **{**v, "luminance": 128.0}))


@pytest.mark.parametrize(("path", "n"), [("a/IMG_0012.CR2", 2), ("IMG_0012.jpg", 12), ("none.jpg", -1), ("7/x.png", -1)])
def test_sequence_is_the_last_run_of_digits(spark, path, n):
    assert one(spark, S.sequence_number(F.lit(path))) == n


def test_capture_times_are_lenient_to_layout_only(spark):
    assert str(one(spark, S.capture_time(F.lit("2026:01:02 03:04:05.9")))) == "2026-01-02 03:04:05"
    assert one(spark, S.capture_time(F.lit("2026:1:1 1:0:0"))) is None
    assert one(spark, S.directory(F.lit("a.jpg"))) == "."


def test_empty_tables_count_to_zero(spark):
    none = spark.createDataFrame([], "id long, status string, error string, suggestion string, decision string")
    assert set(library.counts(none).first().asDict().values()) == {0}


def test_filters_are_validated():
    assert P.filter_set("all", library.AI) == frozenset(library.AI) and P.filter_set("none", library.AI) == frozenset()
    for bad in ("", ",", "keep,other"):
        with pytest.raises(ValueError):
            P.filter_set(bad, library.DECISIONS)


def test_profiles_and_change_plans():
    assert all(not P.validate(p) for p in P.BUILT_IN.values())
    assert P.validate(P.replace(P.BALANCED, quality=P.replace(P.BALANCED.quality, blur_remove=math.inf)))
    q = P.replace(P.BALANCED, quality=P.AGGRESSIVE.quality)
    assert P.change_plan(P.BALANCED, q) == P.RefreshPlan(True, False, False)
    s = P.replace(P.BALANCED, similarity=P.replace(P.BALANCED.similarity, blink=P.Blink(closed_min=0.9)))
    assert P.change_plan(P.BALANCED, s) == P.RefreshPlan(False, False, True)
    assert P.change_plan(P.BALANCED, P.CONSERVATIVE) == P.RefreshPlan(True, True, True)


def test_null_metrics_break_no_rule(spark):
    row = spark.createDataFrame([(1, "", "active", None, None, None, None, None, None, None, 4096, "still")], "id long, error string, status string, sharpness double, luminance double, contrast double, dark_clip double, bright_clip double, entropy double, megapixels double, size long, cover_source string")
    r = quality.classify(row, P.BALANCED).first()
    assert (r["suggestion"], r["reason"]) == ("review", "文件较小")


@pytest.mark.parametrize("radius", [0, 3, 6, 14])
def test_hamming_join_equals_all_pairs(spark, radius):
    rng = random.Random(radius)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in hashes[:30]] + hashes[:2]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [(i, "d", i, signed(h), 0) for i, h in enumerate(hashes)] + [(999, "d", 999, None, 0)]
    df = spark.createDataFrame(rows, "id long, dir string, position long, phash long, dhash long")
    s = P.Similarity(phash_max=radius, dhash_max=64)
    got = {(r["a_id"], r["b_id"]) for r in similarity.hamming_pairs(df, s).collect()}
    assert got == {(i, j) for j in range(len(hashes)) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= radius}


def test_group_confidence_is_the_weakest_link(spark):
    photos = [(i, "active", "", f"p{i}.jpg", float(1000 * i), f"2026:01:01 10:00:0{i}") for i in range(1, 7)]
    df = spark.createDataFrame(photos, "id long, status string, error string, relative_path string, sharpness double, taken string").withColumns({c: F.lit(v) for c, v in dict(luminance=110.0, contrast=40.0, dark_clip=0.0, bright_clip=0.0, entropy=6.0, megapixels=2.0, sha256="", motion_sha256="", blink_status="not_analyzed", blink_face_count=0, blink_uncertain_face_count=0, blink_closed_face_count=0, blink_closed_ratio=-1.0).items()})
    e = spark.createDataFrame([(1, 2, 0.9, "similar", False), (2, 3, 0.8, "similar", True), (4, 5, 0.95, "similar", False)], "a_id long, b_id long, score double, kind string, face_safe boolean")
    got = groups.groups(df, e, P.BALANCED).collect()
    assert [(r["size"], r["recommended_id"], r["face_safe"]) for r in got] == [(3, 3, True), (2, 5, False)]
    assert got[0]["confidence"] == {3: 1.0, 2: 0.8, 1: 0.8} and got[0]["covers"] == [3, 2, 1] and got[0]["member_ids"] == [1, 2, 3]
    ranked = groups.ranked(df, groups.members(df, e), P.BALANCED)
    for most in (0, 1000):  # both ways
        assert {r["id"]: r["confidence"] for r in groups.confidence(ranked, e, most).collect()} == {1: 0.8, 2: 0.8, 3: 1.0, 4: 0.95, 5: 1.0}
    three = P.replace(P.BALANCED, similarity=P.replace(P.BALANCED.similarity, min_group_size=3))
    assert groups.groups(df, e, three).count() == 1


def test_group_confidence_follows_paths_beyond_twelve_edges(spark):
    chain = [(i, i + 1, 0.95) for i in range(1, 16)]  # the widest path to 16 has 15 edges
    links = [*chain, (1, 16, 0.6), (1, 9, 0.7)]
    want = {i: 1.0 if i == 1 else 0.0 for i in range(1, 17)}
    for _ in want:
        for a, b, x in links + [(b, a, x) for a, b, x in links]:
            want[b] = max(want[b], min(want[a], x))
    ranked = spark.createDataFrame([(i, 1, i) for i in want], "id long, component long, rank int")
    e = spark.createDataFrame(links, "a_id long, b_id long, score double")
    for most in (100, 1):
        assert {r["id"]: r["confidence"] for r in groups.confidence(ranked, e, most).collect()} == want


def test_exact_star_prefers_quality_then_id(spark):
    df = spark.createDataFrame([(i, "active", "", "h", "", "image", float(s)) for i, s in ((1, 5), (2, 9), (3, 9))], "id long, status string, error string, sha256 string, motion_sha256 string, media_type string, sharpness double").withColumns({c: F.lit(1.0) for c in ("luminance", "contrast", "dark_clip", "bright_clip", "entropy", "megapixels")})
    assert {(r["a_id"], r["b_id"], r["recommended_id"]) for r in dedupe.exact_star(df, P.BALANCED).collect()} == {(1, 2, 2), (2, 3, 2)}


def test_perceptual_hash_is_the_low_frequencies(spark):
    px = np.random.default_rng(3).integers(0, 256, (32, 32))  # a flat or even raster has coefficients that are 0 but for rounding
    got = raster.phash(spark.createDataFrame([(1, px.ravel().tolist())], "id long, gray array<int>")).first()["phash"]
    c = np.array([[math.cos(math.pi * k * (2 * i + 1) / 64) * math.sqrt((1 if k == 0 else 2) / 32) for i in range(32)] for k in range(32)])
    low = (c @ px @ c.T)[:8, :8]
    assert got == f"{int(''.join('1' if b else '0' for b in (low > np.median(low[1:])).ravel()), 2):016x}"


def test_overlaps_are_suppressed_and_matched_greedily(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 0.0, 10.0, 10.0, 0.8), (1, 3, 30.0, 0.0, 10.0, 10.0, 0.7)], "photo_id long, face_id long, x double, y double, width double, height double, score double")
    assert [r["score"] for r in faces.suppress(b).orderBy("score").collect()] == [0.7, 0.9]
    assert {(r["found_id"], r["truth_id"]) for r in faces.match_faces(b, b).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_detections_of_a_hot_cell():
    n = 80 * 80
    cls, obj, box, marks = np.zeros((n, 1)), np.zeros((n, 1)), np.zeros((n, 4)), np.zeros((n, 10))
    cls[82] = obj[82] = 1
    x, y, w, h, score, points = faces.decode_detections(cls, obj, box, marks, 8)[0]
    assert (x, y, w, h, score) == (12.0, 4.0, 8.0, 8.0, 1.0) and len(points) == 5


def test_listing_keeps_underscored_names_and_refuses_escapes(spark, tmp_path):
    for name in ("_DSC1.JPG", "a/b.mp4", "_cache/x.jpg"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink("/etc/hostname", tmp_path / "out.jpg")
    assert {r["relative_path"] for r in files.list_folder(spark, str(tmp_path)).collect()} == {"_DSC1.JPG", "a/b.mp4"}
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../x")


def test_decision_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    rows = spark.createDataFrame([("keep", "a,b.jpg", "review", "x、y")], "decision string, relative_path string, suggestion string, reason string")
    files.write_decisions(rows, path)
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbf") and b"\r\n" in open(path, "rb").read()
    got = files.read_decisions(spark, path).first()
    assert (got["path"], got["decision"]) == ("a,b.jpg", "keep")


def test_eyes_are_cropped_about_their_centres():
    image = np.zeros((80, 100, 3), np.uint8)
    image[40:] = (255, 128, 0)
    eyes = faces.eye_pair(image, (30.0, 40.0), (70.0, 40.0), 12)
    assert eyes.shape == (2, 3, 24, 40) and eyes.dtype == np.float32
    assert not eyes[:, :, :11].any() and np.allclose(eyes[0, :, 14:, 20], np.array([[1.0], [128 / 255], [0.0]]))
    assert faces.eye_pair(image, (30.0, 40.0), (35.0, 40.0), 12) is None
    assert not faces.eye_crop(image, (-50.0, -50.0), 40, 0.3).any()


def _batch(spark, tmp_path):
    """Three planned photos: one with a clip, one changed since, one gone."""
    (tmp_path / "a").mkdir()
    for name, data in (("a/x.jpg", b"xx"), ("a/x.mov", b"clip"), ("b.jpg", b"changed")):
        (tmp_path / name).write_bytes(data)
    rows = [(1, "a/x.jpg", 2, "move", "a/x.mov", 4), (2, "b.jpg", 1, "move", None, None), (3, "gone.jpg", 1, "move", None, None), (4, "c.jpg", 1, "missing", None, None)]
    return spark.createDataFrame(rows, "id long, relative_path string, size long, state string, motion_relative_path string, motion_size long")


def test_batches_move_and_come_back(spark, tmp_path):
    plan, root = _batch(spark, tmp_path), str(tmp_path)
    assert moves.apply_batch(plan, root, "b1") == {"moved": 1, "changed": 1, "missing": 1}
    assert not (tmp_path / "a/x.jpg").exists() and not (tmp_path / "a/x.mov").exists() and (tmp_path / "b.jpg").exists()
    assert moves.apply_batch(plan, root, "b1") == {"moved": 1, "changed": 1, "missing": 1}  # again: nothing moves
    (tmp_path / "a/x.jpg").write_bytes(b"another")
    assert moves.restore_batch(root, "b1") == {"restored": 1, "conflicts": 1, "missing": 0}
    assert (tmp_path / "a/x.jpg").read_bytes() == b"another" and (tmp_path / "a/x (restored).jpg").read_bytes() == b"xx" and (tmp_path / "a/x.mov").read_bytes() == b"clip"
    assert moves.restore_batch(root, "b1") == {"restored": 0, "conflicts": 0, "missing": 0}
    with pytest.raises(ValueError):
        moves.Ledger(root, "../b1")


def test_cut_off_batches_are_taken_up(spark, tmp_path):
    plan, root = _batch(spark, tmp_path), str(tmp_path)
    ledger = moves.Ledger(root, "b2")
    entry = {"id": 1, "relative_path": "a/x.jpg", "size": 2, "motion_relative_path": "a/x.mov", "motion_size": 4}
    ledger.append({**entry, "state": "moving"})
    os.makedirs(tmp_path / "_quarantine/b2/files/a")
    os.rename(tmp_path / "a/x.jpg", tmp_path / "_quarantine/b2/files/a/x.jpg")  # the clip had not moved yet
    with open(ledger.path, "a") as f:
        f.write('{"id": 1, "sta')
    assert moves.apply_batch(plan.where("id = 1"), root, "b2") == {"moved": 1}
    ledger.append({**entry, "state": "restoring", "back_to": "a/x.jpg", "motion_back_to": "a/x.mov"})
    os.rename(tmp_path / "_quarantine/b2/files/a/x.jpg", tmp_path / "a/x.jpg")
    assert moves.restore_batch(root, "b2") == {"restored": 1, "conflicts": 0, "missing": 0}
    assert (tmp_path / "a/x.jpg").exists() and (tmp_path / "a/x.mov").exists()


def test_half_moves_are_undone(spark, tmp_path):
    plan, root = _batch(spark, tmp_path), str(tmp_path)
    os.makedirs(tmp_path / "_quarantine/b3/files/a/x.mov")  # something stands in the clip's way
    assert moves.apply_batch(plan.where("id = 1"), root, "b3") == {"failed": 1}
    assert (tmp_path / "a/x.jpg").exists() and (tmp_path / "a/x.mov").exists()


def test_snapshots_migrate_and_stream(spark, tmp_path):
    from pyspark.sql import types as T

    from lumisift.streaming.scan import follow

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("relative_path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("decision", T.StringType())])
    store = files.Snapshots(spark, str(tmp_path / "store"), schema, {"decision": ""})
    old = files.Snapshots(spark, str(tmp_path / "store"), T.StructType(schema.fields[:5]), {})
    old.write(spark.createDataFrame([(4, "a.jpg", 1, 1.0, "active")], old.schema))
    assert store.read().first()["decision"] == ""
    spark.createDataFrame([("a.jpg", "jpg", 9, 2.0), ("b.jpg", "jpg", 5, 2.0)], files.LISTING).write.parquet(str(tmp_path / "in"))
    q = follow(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r["id"], r["relative_path"], r["size"]) for r in store.read().collect()} == {(4, "a.jpg", 9), (5, "b.jpg", 5)}
    with pytest.raises(ValueError):
        files.Snapshots(spark, str(tmp_path / "store"), schema, {}, version=3).read()
