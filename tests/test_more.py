"""Behaviour beyond the registered queries: large upserts, joins against all pairs, the face chain, files and refreshes."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.operators import decisions as D
from lumisift.operators import dedupe, faces, graph, quality, raster, refresh, similarity
from lumisift.plans import profiles as P
from lumisift.plans.more import ORACLE_SQL, QUERIES
from lumisift.sources import evaluation, files


def test_upserts_of_a_million_paths_have_distinct_ids(spark):
    n = 1_000_000
    stored = spark.createDataFrame([(7, "p", 1, "keep"), (9, "q", 2, "")], "id long, relative_path string, size long, decision string")
    fresh = spark.range(n, numPartitions=16).select(F.sha1(F.col("id").cast("string")).alias("relative_path"), F.col("id").alias("size")).unionByName(spark.createDataFrame([("p", 5)], "relative_path string, size long"))
    out = D.upsert(stored, fresh)
    got = out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("relative_path").alias("paths")).first()
    assert tuple(got) == (n + 2, n + 2, 7, 9 + n, n + 2)
    some = {r["relative_path"]: r for r in out.where("id < 12 or id > 1000000 + 6").collect()}
    assert (some["p"]["size"], some["p"]["decision"]) == (5, "keep")
    paths = sorted(hashlib.sha1(str(i).encode()).hexdigest() for i in range(n))
    assert {p: r["id"] for p, r in some.items() if p not in "pq"} == {**{paths[i]: 10 + i for i in range(2)}, **{paths[i]: 10 + i for i in range(n - 3, n)}}


def test_imports_skip_what_decides_nothing(spark):
    photos = spark.createDataFrame([(i, p, "keep") for i, p in enumerate(["a.jpg", "b.jpg", "c.jpg", "album/d.jpg", "d.jpg"], 1)], "id long, relative_path string, decision string")
    rows = [(1, "a.jpg", ""), (2, "b.jpg", "undecided"), (3, "c.jpg", "remove"), (4, "c.jpg", "Remove"), (5, "album\\d.jpg", "remove"), (6, "x.jpg", "keep"), (7, None, "keep"), (8, "a.jpg", None)]
    out, totals = D.import_decisions(photos, spark.createDataFrame(rows, "line long, path string, decision string"), "album")
    assert {r["id"]: r["decision"] for r in out.collect()} == {1: "keep", 2: "keep", 3: "remove", 4: "remove", 5: "keep"}
    assert tuple(totals.first()) == (2, 2)


def test_clips_are_guarded_and_the_last_of_a_stem_counts(spark):
    images = spark.createDataFrame([(1, "d/X.jpg", False), (2, "y.jpg", True)], "id long, relative_path string, embedded boolean")
    clips = spark.createDataFrame([("d/x.m4v",), ("d/x.mov",), ("e/x.mov",), ("y.mov",)], "relative_path string")
    got = {r["id"]: (r["motion_kind"], r["motion_relative_path"]) for r in D.sidecars(images, clips).collect()}
    assert got == {1: ("apple_sidecar", "d/x.mov"), 2: ("android_embedded", "y.jpg")}
    kind = "id long, relative_path string, size long, mtime double, decision string, status string, motion_kind string, motion_relative_path string, motion_size long, motion_mtime double"
    photos = [(i, f"{i}.jpg", 10, 1.0, "remove", "active", "apple_sidecar" if i < 5 else "", f"{i}.mov" if i < 5 else None, 4, 2.0) for i in range(1, 6)]
    now = [(f"{i}.jpg", 10, 1.0) for i in range(1, 6)] + [("1.mov", 4, 2.005), ("2.mov", 5, 2.0), ("3.mov", 4, 3.0)]
    plan = D.quarantine_plan(spark.createDataFrame(photos, kind), spark.createDataFrame(now, "relative_path string, size long, mtime double"), "b")
    assert {r["id"]: r["state"] for r in plan.collect()} == {1: "move", 2: "changed", 3: "changed", 4: "missing", 5: "move"}


def test_restored_names_are_free(spark):
    manifest = spark.createDataFrame([(i, p, "moved") for i, p in enumerate(["a.jpg", "b.jpg", "c", "d/e.f.png", "g.jpg"])], "id long, relative_path string, state string")
    taken = spark.createDataFrame([(x,) for x in ("a.jpg", "b.jpg", "b (restored).jpg", "b (restored 2).jpg", "c", "d/e.f.png", "d/e.f (restored 2).png", "g (restored).jpg")], "relative_path string")
    got = {r["relative_path"]: (r["back_to"], r["conflict"]) for r in D.restore_plan(manifest, taken).collect()}
    assert got == {"a.jpg": ("a (restored).jpg", True), "b.jpg": ("b (restored 3).jpg", True), "c": ("c (restored)", True), "d/e.f.png": ("d/e.f (restored).png", True), "g.jpg": ("g.jpg", False)}


@pytest.mark.parametrize("values", [[3.0], [5.0] * 9, [10, 20, 30, 40, 1000.0], "random", "ties", "wide"])
def test_percentiles_equal_sorted_values(spark, values):
    g = np.random.default_rng(1)
    v = {"random": g.normal(size=5000), "ties": g.integers(0, 3, 4000).astype(float), "wide": np.exp(g.normal(0, 40, 3000))}[values] if isinstance(values, str) else np.array(values, float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "s double").repartition(3)
    shares = [0, 0.06, 0.15, 0.5, 0.95, 1]
    assert quality.exact_percentiles(df, "s", shares) == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12)
    assert quality.exact_percentiles(df.where("false"), "s", shares) == [None] * 6
    assert tuple(faces.latency(df.where("false"), "s").first()) == (0.0, 0.0, 0.0)


def test_percentile_profile_of_five(spark):
    df = spark.createDataFrame([(float(x), "active") for x in (10, 20, 30, 40, 1000)], "sharpness double, status string")
    assert tuple(quality.sharpness_percentiles(df, P.BALANCED.quality).first()) == pytest.approx((12.4, 16.0))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("phash", "dhash"), [(11, 10), (16, 14), (64, 12), (20, 30), (64, 64)])
def test_wide_hamming_joins_equal_all_pairs(spark, phash, dhash):
    some = random.Random(phash)
    rows = []
    for i in range(140):
        p, d = (some.getrandbits(64), some.getrandbits(64)) if i % 2 == 0 else rows[-1][3:]
        if i % 2:
            for _ in range(some.randrange(16)):
                p, d = p ^ 1 << some.randrange(64), d ^ 1 << some.randrange(64)
        rows.append((i, "d" if i % 20 else "e", i, p, d))
    df = spark.createDataFrame([(i, f, n, signed(p), signed(d)) for i, f, n, p, d in rows] + [(900, "d", 900, None, None), (901, "d", 901, 0, None)], "id long, dir string, position long, phash long, dhash long")
    got = [(r["a_id"], r["b_id"]) for r in similarity.hamming_pairs(df, P.Similarity(phash_max=phash, dhash_max=dhash), tile_rows=30).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[3] ^ b[3]).bit_count() <= phash and (a[4] ^ b[4]).bit_count() <= dhash}
    if phash == dhash == 64:  # missing hashes are 64 bits away
        want |= {(a[0], x) for a in rows if a[1] == "d" for x in (900, 901)} | {(900, 901)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_thousand_random_hashes_have_few_pairs(spark):
    some = random.Random(14)
    df = spark.createDataFrame([(i, "d", i, signed(some.getrandbits(64)), 0) for i in range(1000)], "id long, dir string, position long, phash long, dhash long")
    assert similarity.hamming_pairs(df, P.Similarity(phash_max=14, dhash_max=64)).count() < 1000 * 999 / 2 / 100


def brute_nearby(rows, gap, minutes):
    out = set()
    for d in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == d), key=lambda r: r[2])
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                near = a[3] >= 0 and b[3] >= 0 and abs(a[3] - b[3]) <= gap
                if not near and not (a[4] is not None and b[4] is not None and abs(a[4] - b[4]) / 60 <= minutes):
                    break
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize(("gap", "minutes"), [(3, 5), (0, 0), (50, 0), (0, 45)])
def test_nearby_pairs_equal_runs(spark, gap, minutes):
    some = random.Random(gap + minutes)
    rows = []
    for d in ("a", "b"):
        seq = sorted(some.choice([-1, some.randrange(300)]) for _ in range(90))
        rows += [(len(rows) + i, d, i, s, None if some.random() < 0.2 else some.randrange(3 * 3600)) for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "id long, dir string, position long, sequence long, at long").withColumn("taken", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, at)"))
    got = [(r["a_id"], r["b_id"]) for r in similarity.nearby_pairs(df, P.Similarity(sequence_gap=gap, time_window_min=minutes)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_nearby(rows, gap, minutes)


def test_a_folder_of_fifty_thousand_is_not_joined_with_itself(spark):
    df = spark.range(50_000).select("id", F.lit("d").alias("dir"), F.col("id").alias("position"), (F.col("id") * 10).alias("sequence"), F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 60)").alias("taken"))
    assert similarity.nearby_pairs(df, P.Similarity(sequence_gap=50, time_window_min=45)).count() == 5 * 50_000 - 15
    hashed = spark.range(50_000).select("id", F.lit("d").alias("dir"), F.col("id").alias("position"), F.xxhash64("id").alias("phash"), F.xxhash64("id", F.lit(1)).alias("dhash"))
    twins = hashed.unionByName(hashed.where("id % 100 = 0").withColumns({"id": F.col("id") + 50_000, "position": F.col("id") + 50_000, "phash": F.col("phash").bitwiseXOR(F.lit(7))}))
    assert similarity.hamming_pairs(twins, P.CONSERVATIVE.similarity).count() == 500


def test_hot_cells_do_not_overflow():
    one = lambda n, v: np.full((1, n), v)
    x, y, w, h, *_ = faces.decode_detections(one(1, 1.0), one(1, 1.0), np.array([[0, 0, 1e4, -1e4]]), one(10, 0.0), 8)[0]
    assert w == pytest.approx(8 * np.exp(20)) and h == pytest.approx(8 * np.exp(-20))


def test_pictures_stand_in_the_middle_of_the_canvas():
    image = np.zeros((100, 200, 3), np.uint8)
    image[:, 100:] = (10, 200, 30)
    canvas, scale, corner = faces.letterbox(image)
    assert canvas.shape == (640, 640, 3) and scale == 3.2 and corner == (0, 160)
    assert not canvas[:160].any() and not canvas[480:].any() and canvas[300, 600].tolist() == [10, 200, 30] and not canvas[300, :300].any()
    assert faces.planes(canvas)[0, :, 300, 600].tolist() == [30, 200, 10]
    shrunk = faces.resized(np.tile(np.arange(256, dtype=np.uint8)[None, :, None], (4, 1, 3)), 2, 64)
    assert shrunk.shape == (2, 64, 3) and np.abs(shrunk[0, 4:-4, 0].astype(int) - (4 * np.arange(64) + 1.5)[4:-4]).max() <= 1


def test_faces_and_their_eyes_are_analysed(spark):
    def load(path, _):
        def face(names, feed):
            assert feed["input"].shape == (1, 3, 640, 640)
            out = {n: np.zeros((1, (640 // int(n.split("_")[1])) ** 2, {"cls": 1, "obj": 1, "bbox": 4, "kps": 10}[n.split("_")[0]]), np.float32) for n in names}
            if feed["input"].any():
                for cell, wide in ((20 * 20 // 2 + 5, 4.0), (20 * 20 // 2 + 14, 0.2)):  # the second's eyes are close together
                    out["cls_32"][0, cell] = out["obj_32"][0, cell] = 0.9
                    out["bbox_32"][0, cell] = (0, 0, 1, 1)
                    out["kps_32"][0, cell, :4] = (0, 0, wide, 0)
            return [out[n] for n in names]

        def eyes(names, feed):
            assert names == ["prob_open"] and feed["images"].shape[1:] == (3, 24, 40)
            return [np.tile(np.array([0.95, 0.05], np.float32), len(feed["images"]) // 2)]

        return face if path == "face" else eyes

    rgb = np.full((64, 64, 3), 90, np.uint8).tobytes()
    rows = spark.createDataFrame([(1, 64, 64, rgb), (2, 64, 64, bytes(64 * 64 * 3)), (3, 9, 9, rgb)], "photo_id long, height int, width int, rgb binary")
    found = faces.analyse(rows, ("face", ""), ("eye", ""), P.Blink(), load)
    got = found.collect()
    assert [r["photo_id"] for r in got if not r["error"]] == [1, 1] and [r["photo_id"] for r in got if r["error"]] == [3]
    assert sorted((round(r["eye_distance"], 1), r["p_right"]) for r in got if not r["error"]) == [(6.4, None), (128.0, pytest.approx(0.95))]
    roll = {r["photo_id"]: r for r in faces.blink_rollup(found.where("error = ''"), rows, P.Blink()).collect()}
    assert (roll[1]["blink_status"], roll[1]["blink_face_count"], roll[1]["blink_closed_face_count"], roll[1]["blink_uncertain_face_count"], roll[1]["blink_closed_ratio"]) == ("closed", 2, 1, 1, 1.0)
    assert roll[2]["blink_status"] == "no_face"


def test_models_are_held_against_their_checksum(tmp_path):
    (tmp_path / "m").write_bytes(b"model")
    with pytest.raises(ValueError, match="expected"):
        faces.model_of(str(tmp_path / "m"), "0" * 64)


def test_hashes_of_a_batch_equal_single_ones(spark):
    g = np.random.default_rng(5)
    px = g.integers(0, 256, (20, 1024))
    got = {r["id"]: r["phash"] for r in raster.phash(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(px)] + [(90, [1, 2]), (91, None)], "id long, gray array<int>")).collect()}
    assert got == {**{i: f"{int(raster.phashes_of(x[None])[0]):016x}" for i, x in enumerate(px)}, 90: None, 91: None}


def test_manifests_have_their_fields_and_are_swapped_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.jpg", 5, "move", "b/a.jpg")], "id long, relative_path string, size long, state string, target string")
    for _ in range(2):
        files.write_manifest(rows, str(tmp_path / "m"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "m/csv").iterdir() if p.suffix == ".csv"]  # some without rows
    (row,) = [r for lines in parts for r in csv.DictReader(lines)]
    assert list(row) == list(files.MANIFEST) and (row["photo_id"], row["quarantine_path"], row["restore_path"], row["status"]) == ("1", "b/a.jpg", "", "move")
    assert spark.read.json(str(tmp_path / "m/json")).first()["target"] == "b/a.jpg" and sorted(os.listdir(tmp_path / "m")) == ["csv", "json"]


def test_heads_and_thumbnails_are_rows_with_or_without_errors(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b'\xff\xd8<x GCamera:MotionPhoto="1" MotionPhotoOffset="4"/>clip')
    rows = spark.createDataFrame([("a.jpg", "jpg", 1, 1.0), ("gone.jpg", "jpg", 1, 1.0), ("b.png", "png", 1, 1.0)], files.LISTING)
    heads = files.read_heads(rows, str(tmp_path))
    m = {r["relative_path"]: r["m"] for r in heads.select("relative_path", D.embedded_motion(F.col("relative_path"), F.col("head"), F.col("size")).alias("m")).collect()}
    size = os.path.getsize(tmp_path / "a.jpg")
    assert tuple(m["a.jpg"]) == (size - 4, 4, -1) and m["gone.jpg"] is None and "b.png" not in m
    (tmp_path / "old.jpg").write_bytes(b"old")
    got = files.write_thumbnails(spark.createDataFrame([("old.jpg", 2, 2, b"xx"), ("../out.jpg", 1, 1, b"abc")], "name string, height int, width int, rgb binary"), str(tmp_path)).collect()
    assert all(r["error"] for r in got) and (tmp_path / "old.jpg").read_bytes() == b"old" and not (tmp_path.parent / "out.jpg").exists()


def test_evaluation_tables_are_read_checked_and_reported(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿photo_id,group_id,path,quality_score,authorized,license_id\n1,g,a.jpg,.5,yes,L\n2,g,b.jpg,.6,是,L\n2,,c.jpg,.6,no,L\n3,,d.jpg,x,1,\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("photo_id,face_id,x,y,width,height,status,primary\n1,f,1,2,3,4,Open,true\n9,f,1,2,3,4,odd,no\n2,f,,2,3,4,closed,\n", encoding="utf-8")
    manifest, notes = evaluation.read_manifest(spark, str(tmp_path / "m.csv")), evaluation.read_annotations(spark, str(tmp_path / "a.csv"))
    got = {(r["photo_id"], r["fault"]) for r in evaluation.faults(manifest, notes).collect()}
    assert got == {("2", "not authorised"), ("3", "no licence"), ("2", "id used twice"), (None, "too few photos"), (None, "too few bursts"), ("9", "unknown state"), ("2", "no number"), ("9", "unknown"), ("3", "missing")}
    assert {r["photo_id"]: r["primary"] for r in notes.collect()} == {"1": True, "9": False, "2": True}
    report = {"photos": 2, "precision": 0.96, "recall": 0.7, "recommendation_success_rate": 0.9, "p50": 50.0}
    met = evaluation.write_report(report, notes, manifest, str(tmp_path / "out"))
    assert met == {"precision": True, "recall": False, "recommendation_success_rate": True, "p50": True}
    assert json.loads((tmp_path / "out/report.json").read_text())["release_gates"] == met and "failed: recall" in (tmp_path / "out/report.md").read_text()
    assert (tmp_path / "out/predictions.csv").read_text(encoding="utf-8-sig").startswith("photo_id,face_id")


def test_topologies_are_built_once_until_something_changes(spark):
    kept = refresh.Topologies()
    build = lambda: spark.range(3)
    for _ in range(3):
        assert kept.get("p", P.BALANCED, True, build).count() == 3
    assert kept.builds == 1
    kept.get("p", P.AGGRESSIVE, True, build), kept.get("p", P.BALANCED, False, build), kept.get("q", P.BALANCED, True, build)
    assert kept.builds == 4
    kept.invalidate("p")
    kept.get("q", P.BALANCED, True, build)
    assert kept.builds == 4 and kept.get("p", P.BALANCED, True, build).count() == 3 and kept.builds == 5


def test_a_partial_refresh_keeps_exact_edges(spark):
    kind = "id long, relative_path string, status string, error string, sha256 string, motion_sha256 string, media_type string, phash long, dhash long, width int, height int, structure array<double>, thumbnail string, taken timestamp, "
    kind += ", ".join(f"{c} double" for c in ("sharpness", "luminance", "contrast", "dark_clip", "bright_clip", "entropy", "megapixels"))
    shape = [[1.0, -1.0, 0.5], [1.0, -1.0, 0.5], [-1.0, 1.0, 0.0]]
    rows = [(i, f"d/{i}.jpg", "active", "", "h" if i in (4, 5) else f"h{i}", "", "image", 0, 0, 12, 8, shape[i % 3 == 0], "t", None, 100.0, 110.0, 40.0, 0.0, 0.0, 6.0, 2.0) for i in range(1, 7)]
    photos = spark.createDataFrame(rows, kind)
    old = spark.createDataFrame([(1, 2, 0.9, "similar", 1), (2, 3, 0.9, "similar", 2), (4, 5, 1.0, "exact", 4), (3, 6, 0.9, "similar", 3)], "a_id long, b_id long, score double, kind string, recommended_id long")
    same, edges, blinks = refresh.refresh(photos, old, P.BALANCED, P.replace(P.photo_plan(2), reclassify=False))
    got = {(r["a_id"], r["b_id"]): r["kind"] for r in edges.collect()}
    every = {(r["a_id"], r["b_id"]): r["kind"] for r in refresh.rebuild(photos, None, P.BALANCED).collect()}
    assert every[4, 5] == "exact" and got[4, 5] == "exact" and got[3, 6] == "similar"
    assert {p for p in got if 2 in p} == {p for p in every if 2 in p} and same is photos
    near = {x for p in got if 2 in p for x in p} | {2}
    assert {r["id"] for r in blinks.collect()} == near


def test_reclassifying_some_leaves_others(spark):
    row = lambda i, s: (i, "", "active", s, 110.0, 40.0, 0.0, 0.0, 6.0, 2.0, 1 << 20, "still", "old", "old", 0.0)
    df = spark.createDataFrame([row(1, 5.0), row(2, 5.0), row(3, 900.0)], "id long, error string, status string, sharpness double, luminance double, contrast double, dark_clip double, bright_clip double, entropy double, megapixels double, size long, cover_source string, suggestion string, reason string, quality_score double")
    ids = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: r["suggestion"] for r in quality.reclassify(df, P.BALANCED, ids).collect()} == {1: "remove", 2: "old", 3: "old"}
    by_share = P.replace(P.BALANCED, quality=P.replace(P.BALANCED.quality, threshold_mode="percentile"))
    assert all(r["suggestion"] != "old" for r in quality.reclassify(df, by_share, ids).collect())


def test_components_of_odd_graphs(spark):
    some = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(500, 600 + i) for i in range(300)] + [(some.randrange(1000, 1400), some.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (3, 2), (2, 3)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_a_cluster_must_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            graph.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_profiles_are_held_to_types_and_ranges():
    q, s = P.BALANCED.quality, P.BALANCED.similarity
    weights = lambda **w: P.replace(P.BALANCED, quality=P.replace(q, weights=tuple({**dict(q.weights), **w}.items())))
    bad = [weights(sharpness=-1), weights(sharpness=11), weights(**dict.fromkeys(P.WEIGHTS, 0)), P.replace(P.BALANCED, quality=P.replace(q, weights=q.weights[1:]))]
    bad += [P.replace(P.BALANCED, quality=P.replace(q, **x)) for x in ({"dark_review": 256}, {"blur_review": "9"}, {"entropy_review": 8.1}, {"contrast_remove": True})]
    bad += [P.replace(P.BALANCED, similarity=P.replace(s, **x)) for x in ({"cross_time": 1}, {"min_group_size": 1}, {"sequence_gap": 10_001}, {"structure_min": -1.1}, {"blink": P.Blink(open_min=0.5, closed_min=0.5)}, {"blink": P.Blink(eye_distance_min=12.5)}, {"blink": P.Blink(coverage_min=0.4)})]
    assert all(P.validate(p) for p in bad)
    assert not P.validate(P.replace(P.BALANCED, similarity=P.replace(s, structure_min=-0.5))) and P.validate_name("  ") and not P.validate_name("x" * 40) and P.validate_name("x" * 41)


def test_motion_bytes_are_hashed_by_place(spark):
    photos = spark.createDataFrame([(i, "active", "", 7, "motion_photo", "", 3 if i % 2 else None, 2 if i % 2 else None) for i in range(3)], "id long, status string, error string, size long, media_type string, motion_sha256 string, motion_offset long, motion_length long")
    got = {r["id"]: r["motion_sha256"] for r in dedupe.motion_hashes(photos, spark.createDataFrame([(i, bytearray(b"abcdefg")) for i in range(3)], "id long, content binary")).collect()}
    assert got == {0: hashlib.sha256(b"abcdefg").hexdigest(), 1: hashlib.sha256(b"de").hexdigest(), 2: hashlib.sha256(b"abcdefg").hexdigest()}


def _orders(tmp_path, rows):
    """A folder with an orders table of (key, customer, day of January 2001), and a connection that sees it."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, make_timestamp(2001, 1, d, 0, 0, 0) AS o_orderdate FROM (VALUES {', '.join(map(str, rows))}) t(k, c, d)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    return con


LONG_KEYS = [0, 7, 99_999, 100_000, 999_998, 999_999, 1_000_000, 1_000_001, 1_000_002, 8_999_999, 12_345_678, 12_345_679, 3_000_000_001, 10**18]


def test_keys_of_numbers_beyond_six_digits(spark, tmp_path):
    con = _orders(tmp_path, [(k, 4, 1 + k % 28) for k in LONG_KEYS])
    df = QUERIES["photo_keys"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['photo_keys']}) ORDER BY id").fetchall()
    assert [tuple(r) for r in df.orderBy("id").collect()] == want


def test_shots_of_numbers_beyond_six_digits_are_in_order(spark, tmp_path):
    timed = [1_000_001, 1_000_003, 999_998, 200_003, 12_345_679, 3_000_000_001, 100_002, 3_000_000_003]
    untimed = [1_000_010, 990_010, 999_990, 20_000_020, 100_020, 200_010]
    con = _orders(tmp_path, [(k, 4, 1) for k in timed + untimed] + [(k, 5, 1 + k % 28) for k in LONG_KEYS])
    got = [tuple(r) for r in QUERIES["shooting_order"](spark, str(tmp_path)).orderBy("id", "place").collect()]
    assert len(got) == len(timed + untimed + LONG_KEYS)
    assert got == con.execute(f"SELECT id, place FROM ({ORACLE_SQL['shooting_order']}) ORDER BY id, place").fetchall()


def test_shots_of_equal_cut_paths_are_in_order_of_id(spark, tmp_path):
    keys = [100_020 * 10**e for e in (3, 1, 4, 0, 2)]
    _orders(tmp_path, [(k, 4, 1) for k in keys])
    got = [tuple(r) for r in QUERIES["shooting_order"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(k, i + 1) for i, k in enumerate(sorted(keys))]
