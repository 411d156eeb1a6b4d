"""Further registered queries: hashes of whole rasters, payloads, what-if counts, covers, hashing, checks of evaluation tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import decisions as D
from lumisift.operators import dedupe, faces, groups, library, quality, raster, refresh, similarity
from lumisift.plans import adapters as A
from lumisift.plans.catalog import _GROUPS, _SCORE, _STAR, LOOSE, ORACLE_SQL, PERCENT, QUERIES, _boxes, _classified, _edges, query, r6
from lumisift.plans.profiles import BALANCED, Blink, RefreshPlan, blink_thresholds
from lumisift.sources import evaluation

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- rasters

_PIXEL = "((gray[i % 64 + 1] * (1 + ((i // 32) * 37 + (i % 32) * 11) % 13)) % 256)::DOUBLE"


@query(f"""WITH {A.V_PX}, px AS (SELECT id, i, {_PIXEL} AS g FROM v_px, range(1024) t(i)),
c AS (SELECT u, x, cos(pi() * u * (2 * x + 1) / 64) * CASE WHEN u = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END AS w FROM
 range(8) a(u), range(32) b(x)),
lines AS (SELECT id, i // 32 AS r, u AS v, sum(g * w) AS s FROM px JOIN c ON c.x = i % 32 GROUP BY ALL),
low AS (SELECT id, c.u, v, sum(s * w) AS k FROM lines JOIN c ON c.x = r GROUP BY ALL),
m AS (SELECT id, median(k) FILTER (u > 0) AS mid FROM low GROUP BY id)
SELECT id, lower(lpad(to_hex(sum(CASE WHEN k > mid THEN 1::HUGEINT << (63 - u * 8 - v)::INTEGER ELSE 0 END)::UBIGINT), 16, '0')) AS phash
 FROM low JOIN m USING (id) GROUP BY id""")
def raster_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = "gray[i % 64] * (1 + ((i div 32) * 37 + (i % 32) * 11) % 13) % 256"
    px = A.vectors_as_rasters(spark, sf_dir).selectExpr("id", f"transform(sequence(0, 1023), i -> cast({pixel} as int)) as gray")
    return raster.phash(px)


# ---- library

_MOTION = """motion AS (SELECT *, id % 3 = 0 AS moving, id % 5 AS revision, (id % 40) * 100 AS duration, (id % 4) * 10.0::DOUBLE AS fps,
 CASE WHEN id % 7 = 0 THEN -1 ELSE (id % 10) / 10.0::DOUBLE END AS ratio FROM v_doc)"""


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.lit(0) for c in ("motion_frame_count", "motion_width", "motion_height", "motion_still_time_ms", "cover_frame_index")}
    d = A.docs_as_photos(spark, sf_dir)
    return d.withColumns({
        **none, "cover_time_ms": F.lit(0).cast("long"), "cover_source": F.lit("still"), "motion_error": F.lit(""), "cover_revision": (F.col("id") % 5).cast("int"),
        "media_type": F.expr("if(id % 3 = 0, 'motion_photo', 'image')"), "motion_duration_ms": (F.col("id") % 40 * 100).cast("long"),
        "motion_fps": (F.col("id") % 4 * 10).cast("double"), "blink_closed_ratio": F.expr("if(id % 7 = 0, -1D, (id % 10) / 10D)"),
    })


@query(f"""WITH {A.V_DOC}, {_MOTION} SELECT id, 'p1' AS project_id, CASE WHEN error = '' THEN round_even(greatest(0, least(1, {_SCORE})) *
 100, 1) END AS quality_score,
 CASE WHEN ratio >= 0 THEN ratio END AS blink_closed_ratio, concat('/api/thumb?project_id=p1&id=', id, '&token=t&v=', revision) AS thumb_url,
CASE WHEN moving THEN concat('/api/motion/video?project_id=p1&id=', id, '&token=t&v=', revision) END AS video_url, CASE WHEN moving THEN
 duration END AS duration_ms,
 CASE WHEN moving THEN fps END AS fps FROM motion""")
def photo_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = library.payload(_motion(spark, sf_dir), BALANCED, "p1", "t")
    return p.select("id", "project_id", "quality_score", "blink_closed_ratio", "thumb_url", "motion.video_url", "motion.duration_ms", "motion.fps")


@query(f"""WITH {A.V_DOC}, n AS (SELECT suggestion, count(*) AS n FROM v_doc WHERE status = 'active' GROUP BY 1), d AS (SELECT decision,
 count(*) AS n FROM v_doc WHERE status = 'active' AND decision <> '' AND id % 2 = 1 GROUP BY 1)
SELECT (SELECT count(*) FROM v_doc WHERE status = 'active') AS total, (SELECT string_agg(concat(suggestion, '=', n), ',' ORDER BY suggestion) FROM n) AS counts,
 (SELECT string_agg(concat(decision, '=', n), ',' ORDER BY decision) FROM d WHERE decision = 'keep') AS decisions""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.docs_as_photos(spark, sf_dir).withColumn("decision", F.expr("if(decision = 'keep' and id % 2 = 1, 'keep', '')"))  # nothing to remove: no such entry

    def text(c: str) -> F.Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias(c)

    return library.project_counts(photos).select("total", text("counts"), text("decisions"))


@query(f"""WITH {A.V_DOC}, {_MOTION}, asked AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'motion' ELSE 'still' END AS src, (id % 50) * 90 AS t
 FROM v_doc WHERE id % 4 < 3),
ok AS (SELECT m.id, src, CASE WHEN src = 'motion' THEN least(t, greatest(0, duration - CASE WHEN fps > 0 THEN greatest(1, ceil(1000 / fps))
 ELSE 1 END))::BIGINT ELSE 0 END AS spot
 FROM motion m JOIN asked a ON a.id = m.id WHERE status = 'active' AND moving AND (src = 'still' OR duration > 0 AND t BETWEEN 0 AND duration))
SELECT m.id, coalesce(src, 'still') AS cover_source, coalesce(spot, 0) AS cover_time_ms, coalesce(round_even(spot * fps / 1000, 0)::INTEGER,
 0) AS cover_frame_index,
revision + CASE WHEN ok.id IS NULL THEN 0 ELSE 1 END AS cover_revision, CASE WHEN ok.id IS NULL THEN thumbnail ELSE
 concat(sha1(relative_path), '.cover-', revision + 1, '.jpg') END AS thumbnail
FROM motion m LEFT JOIN ok ON ok.id = m.id""")
def cover_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _motion(spark, sf_dir)
    asked = photos.where("id % 4 < 3").selectExpr("id", "if(id % 2 = 0, 'motion', 'still') as source", "(id % 50) * 90 as time_ms")
    return refresh.cover_update(photos, asked).select("id", "cover_source", "cover_time_ms", "cover_frame_index", F.col("cover_revision").cast("long").alias("cover_revision"), "thumbnail")


@query("SELECT user_id AS project_id, max(ts) AS last_opened FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recents(A.table(spark, sf_dir, "events").selectExpr("user_id as project_id", "ts as at")).withColumnRenamed("at", "last_opened")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def quarantine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.batches_newest_first(A.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderdate as created_at"))
    return D.numbered(b.select("id", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age")).withColumn("_by", F.struct("age", -F.col("id"))), "_by").selectExpr("id", "n as place")


@query(f"""WITH {A.V_DOC} SELECT DISTINCT e.event_id % 300 AS id FROM events e WHERE NOT EXISTS (SELECT 1 FROM v_doc v WHERE v.id = e.event_id % 300
 AND v.status = 'active')""")
def refused_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.table(spark, sf_dir, "events").selectExpr("event_id % 300 as id", "event_id as at", "'keep' as decision")
    return D.refused(A.docs_as_photos(spark, sf_dir), log)


# ---- scans and hashes


@query(f"""WITH {A.V_DOC}, s AS (SELECT size FROM v_doc WHERE status = 'active' AND error = '' GROUP BY size HAVING count(*) > 1), h AS
 (SELECT *, status = 'active' AND size IN (SELECT size FROM s) AS wanted FROM v_doc)
SELECT id, CASE WHEN wanted AND id % 9 = 0 THEN 'missing' ELSE status END AS status, CASE WHEN wanted THEN CASE WHEN id % 9 = 0 THEN '' ELSE
 sha256(text) END ELSE '' END AS sha256 FROM h""")
def status_after_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.docs_as_photos(spark, sf_dir).withColumn("sha256", F.lit(""))
    hashes = dedupe.hash_candidates(photos, "text")
    return dedupe.after_hashing(photos, hashes, photos.where("id % 9 <> 0")).select("id", "status", "sha256")


@query(f"""WITH {A.V_DOC}, s AS (SELECT size FROM v_doc WHERE status = 'active' AND error = '' GROUP BY size HAVING count(*) > 1)
SELECT id, sha256(CASE WHEN id % 2 = 0 THEN encode(concat('head', id, '-', id % 1000, 'tail')) ELSE encode(concat(id, '-')) END) AS
 motion_sha256 FROM v_doc WHERE status = 'active' AND id % 3 = 0 AND size IN (SELECT size FROM s)""")
def motion_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _motion(spark, sf_dir).withColumns({"motion_sha256": F.lit(""), "motion_offset": F.expr("if(id % 2 = 0, 0, 4)"), "motion_length": F.expr("if(id % 2 = 0, 0, length(cast(id as string)) + 1)")})
    clips = photos.selectExpr("id", "encode(concat('head', id, '-', id % 1000, 'tail'), 'UTF-8') as content")
    return dedupe.motion_hashes(photos, clips)


_HEAD = """concat('<x:xmpmeta ', CASE id % 3 WHEN 0 THEN 'GCamera:MotionPhoto="1"' WHEN 1 THEN 'Camera:MicroVideo = ''1''' ELSE 'GCamera:MotionPhoto="0"' END,
CASE id % 4 WHEN 0 THEN concat(' GCamera:MicroVideoOffset="', id * 3, '"') WHEN 1 THEN
 concat('><Item Mime="image" Item:Semantic="Primary" Item:Length="7"/><Item Item:Semantic="MotionPhoto" Item:Length="', id + 5, '"/') ELSE
 '' END,
 CASE WHEN id % 5 = 0 THEN concat(' GCamera:MotionPhotoPresentationTimestampUs="', id * 1000, '"') ELSE '' END, '>')"""


@query(f"""WITH e AS (SELECT event_id AS id, 2000 + event_id AS size, event_id % 6 <> 5 AS jpeg, {_HEAD.replace("id", "event_id")} AS head FROM events),
l AS (SELECT *, CASE id % 4 WHEN 0 THEN id * 3 WHEN 1 THEN id + 5 END AS n FROM e WHERE id % 3 < 2 AND jpeg)
SELECT id, size - n AS "offset", n AS length, CASE WHEN id % 5 = 0 THEN id * 1000 ELSE -1 END AS timestamp_us FROM l WHERE n > 0 AND n < size""")
def embedded_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = """concat('<x:xmpmeta ', case id % 3 when 0 then 'GCamera:MotionPhoto="1"' when 1 then "Camera:MicroVideo = '1'" else 'GCamera:MotionPhoto="0"' end,
case id % 4 when 0 then concat(' GCamera:MicroVideoOffset="', id * 3, '"') when 1 then
 concat('><Item Mime="image" Item:Semantic="Primary" Item:Length="7"/><Item Item:Semantic="MotionPhoto" Item:Length="', id + 5, '"/') else
 '' end,
        case when id % 5 = 0 then concat(' GCamera:MotionPhotoPresentationTimestampUs="', id * 1000, '"') else '' end, '>')"""
    e = A.table(spark, sf_dir, "events").selectExpr("event_id as id").selectExpr("id", "2000 + id as size", "concat('d/', id, if(id % 6 = 5, '.heic', '.JPG')) as path", f"{head} as head")
    return e.select("id", D.embedded_motion(F.col("path"), F.col("head"), F.col("size")).alias("m")).where("m is not null").select("id", "m.offset", "m.length", "m.timestamp_us")


# ---- pairs and groups


@query(f"WITH {A.V_HASH} SELECT a_id, b_id, round(score, 6) AS score FROM v_edges WHERE (a_id + b_id) % 3 <> 0")
def similar_pairs_not_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, edges = _edges(spark, sf_dir)
    exact = edges.where("(a_id + b_id) % 3 = 0").select("a_id", "b_id")
    return similarity.similar_pairs(photos, exact, LOOSE).select("a_id", "b_id", r6("score"))


_CLOSE = replace(LOOSE, similarity=replace(LOOSE.similarity, cross_time=False, sequence_gap=20, time_window_min=0))


@query(f"""WITH {A.V_HASH}, p AS (SELECT id, dir, row_number() OVER (PARTITION BY dir ORDER BY id % 200, id) AS position, id % 200 AS seq
 FROM v_hash), j AS (SELECT a.id AS a, b.id AS b, a.position AS ap, b.position AS bp,
b.seq - a.seq <= 20 AS near FROM p a JOIN p b ON a.dir = b.dir AND a.position < b.position), w AS (SELECT *, bool_and(near) OVER (PARTITION
 BY a ORDER BY bp ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT a_id, b_id, round(score, 6) AS score FROM v_edges JOIN w ON a_id = least(a, b) AND b_id = greatest(a, b) WHERE run""")
def similar_pairs_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.vectors_as_hashes(spark, sf_dir).drop("position").withColumns({"sequence": F.col("id") % 200, "relative_path": F.lpad(F.col("id").cast("string"), 12, "0"), "taken": F.lit(None).cast("timestamp")})
    none = spark.createDataFrame([], "a_id long, b_id long")
    return similarity.similar_pairs(dedupe.by_position(photos), none, _CLOSE).select("a_id", "b_id", r6("score"))


@query(f"""WITH {_GROUPS.replace("src AS", "src0 AS").replace("FROM src)", "FROM src0)")}, src AS (SELECT id, (id * 7) % 100 AS sharpness,
 110 AS luminance, 40 AS contrast, 0 AS dark_clip, 0 AS bright_clip, 6 AS entropy, 2 AS megapixels, id % 97 * 4096 AS size, 'still' AS
 cover_source, '' AS error FROM v_hash), {_classified(LOOSE.quality)}
SELECT count(*) FILTER (suggestion = 'keep') AS keep, count(*) FILTER (suggestion = 'review') AS review, count(*) FILTER (suggestion =
 'remove') AS remove, count(*) FILTER (suggestion = 'unreadable') AS unreadable,
 (SELECT count(*) FROM v_edges) AS pairs, (SELECT count(DISTINCT component) FROM comp) AS groups FROM classified""")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.vectors_as_hashes(spark, sf_dir).withColumns({"size": F.col("id") % 97 * 4096, "cover_source": F.lit("still"), "media_type": F.lit("image")})
    return refresh.what_if(photos, LOOSE)


@query(f"WITH {_GROUPS} SELECT (SELECT count(*) FROM v_edges) AS pairs, (SELECT count(DISTINCT component) FROM comp) AS groups")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, edges = _edges(spark, sf_dir)
    return refresh.summary(photos, edges.select("a_id", "b_id", "score", "kind"), LOOSE)


@query(f"""WITH {A.V_DOC}, {_STAR}, m AS (SELECT a_id AS id, recommended_id AS best FROM star UNION SELECT b_id, recommended_id FROM star)
SELECT min(id) AS component, 'exact' AS kind, best AS recommended_id, count(*) AS size, 1.0::DOUBLE AS least_confidence FROM m GROUP BY best""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {"blink_face_count": F.lit(0), "blink_uncertain_face_count": F.lit(0), "blink_closed_face_count": F.lit(0), "blink_closed_ratio": F.lit(-1.0), "blink_status": F.lit("not_analyzed"), "taken": F.lit("")}
    photos = A.docs_as_photos(spark, sf_dir).withColumns(none).withColumn("relative_path", F.lpad(F.col("id").cast("string"), 12, "0"))
    edges = dedupe.exact_star(photos, BALANCED).withColumn("face_safe", F.lit(False))
    g = groups.groups(photos, edges, BALANCED)
    return g.select("component", "kind", "recommended_id", "size", F.array_min(F.map_values("confidence")).alias("least_confidence"))


@query(f"""WITH {A.V_DOC}, g AS (SELECT id // 4 AS group_id, list(id ORDER BY id) AS ids FROM v_doc GROUP BY 1), e AS (SELECT group_id,
 len(ids) AS n, unnest(ids) AS id FROM g),
h AS (SELECT e.group_id, any_value(n) AS n, count(*) AS hit, list(v.relative_path ORDER BY e.id) AS paths FROM e JOIN v_doc v ON v.id = e.id
 AND v.status = 'active' GROUP BY 1)
SELECT group_id, array_to_string(list_filter(paths, lambda p: contains(lower(p), 'src2/')), ',') AS paths FROM h WHERE hit = n""")
def member_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.docs_as_photos(spark, sf_dir)
    topology = photos.groupBy(F.expr("id div 4").alias("group_id")).agg(F.array_sort(F.collect_list("id")).alias("member_ids"))
    h = groups.search_members(groups.hydrate(topology, photos), "Src2/")
    return h.select("group_id", F.array_join(F.transform("members", lambda m: m.relative_path), ",").alias("paths"))


# ---- blinks

_SEEN = """seen AS (SELECT event_id AS id, event_id % 3 + 1 AS rank, CASE WHEN event_id % 7 = 0 THEN 'exact' ELSE 'similar' END AS kind,
 event_id % 6 AS n, event_id % 4 AS unsure, event_id % 2 AS closed,
 CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'no_face' ELSE 'error' END AS blink_status FROM events)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "event_id % 3 + 1 as rank", "if(event_id % 7 = 0, 'exact', 'similar') as kind", "event_id % 6 as blink_face_count", "event_id % 4 as blink_uncertain_face_count",
        "event_id % 2 as blink_closed_face_count", "element_at(array('open', 'closed', 'uncertain', 'no_face', 'error'), cast(event_id % 5 as int) + 1) as blink_status",
        "if(event_id % 4 = 0, 'old', 'm1') as blink_model_version",
    )


@query(f"""WITH {_SEEN} SELECT id, rank > 1 AND kind = 'similar' AND blink_status = 'closed' AND closed >= 1 AND n > 0 AND (n - unsure) >= 0.8 * n AS
 badge FROM seen""")
def blink_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.blink_badge(_seen(spark, sf_dir), Blink().coverage_min).select("id", "badge")


_PRINT = """lower(sha256(concat('{"cover_revision":', event_id % 3, ',"cover_source":', CASE WHEN event_id % 8 = 0 THEN 'null' ELSE
 '"still"' END, ',"cover_time_ms":', event_id % 1000,
',"model":"m1","thresholds":"{\\"closed_confidence_min\\":0.85,\\"face_confidence_min\\":0.8,\\"min_eye_distance_px\\":12,\\"open_confidence_min\\":0.8,\\"reliable_coverage_min\\":0.8}","thumbnail_mtime_ns":',
 event_id * 7, ',"thumbnail_size":', event_id * 3, '}')))"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    parts = {
        "thumbnail_size": e * 3, "thumbnail_mtime_ns": e * 7, "cover_source": F.when(e % 8 != 0, F.lit("still")), "cover_time_ms": e % 1000, "cover_revision": e % 3,
        "model": F.lit("m1"), "thresholds": F.lit(blink_thresholds(Blink())),
    }
    return A.table(spark, sf_dir, "events").select(e.alias("id"), S.blink_fingerprint(**parts).alias("fingerprint"))


@query(f"SELECT event_id AS id, {_PRINT} AS fingerprint FROM events")
def blink_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seen(spark, sf_dir).join(_prints(spark, sf_dir), "id")
    return rows.withColumn("blink_input_fingerprint", F.expr("if(id % 11 = 0, 'other', fingerprint)"))


@query(f"WITH {_SEEN} SELECT id, blink_status IN ('open', 'closed', 'uncertain', 'no_face') AND id % 4 <> 0 AND id % 11 <> 0 AS reusable FROM seen")
def blink_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("id", faces.blink_current("m1", F.col("fingerprint")).alias("reusable"))


@query(f"""WITH {_SEEN}, r AS (SELECT id % 6 AS part, blink_status <> 'error' AND id % 4 <> 0 AND id % 11 <> 0 AS ok FROM seen) SELECT (SELECT
 bool_or(NOT ok) FROM r) AS every, coalesce((SELECT bool_or(NOT ok) FROM r WHERE ok), false) AS fresh""")
def blink_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir)
    fresh = rows.where(faces.blink_current("m1", F.col("fingerprint")))
    every = faces.rescan_required(rows, "m1", F.col("fingerprint")).withColumnRenamed("required", "every")
    return every.join(faces.rescan_required(fresh, "m1", F.col("fingerprint")).withColumnRenamed("required", "fresh"))  # one row each


def _iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    return f"({w} * {h} / greatest({a}.width * {a}.height + {b}.width * {b}.height - {w} * {h}, 1e-12))"


_BOXES = """boxes AS (SELECT user_id AS photo_id, event_id AS face_id, (event_id * 13 % 200)::DOUBLE AS x, (event_id * 29 % 200)::DOUBLE AS
 y, (20 + event_id % 30)::DOUBLE AS width,
 (20 + event_id % 25)::DOUBLE AS height, (event_id % 97)::DOUBLE / 97 AS score FROM events)"""


@query(f"""WITH RECURSIVE {_BOXES}, r AS (SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, x, y, width, height) AS k,
 {{'x': x, 'y': y, 'width': width, 'height': height, 'score': score}} AS b FROM boxes),
s(photo_id, k, kept) AS (SELECT photo_id, 1::BIGINT, [b] FROM r WHERE k = 1 UNION ALL SELECT s.photo_id, r.k,
CASE WHEN len(kept) < 10 AND len(list_filter(kept, lambda o: {_iou("o", "r.b")} > 0.3)) = 0 THEN list_append(kept, r.b) ELSE kept END FROM s
 JOIN r ON r.photo_id = s.photo_id AND r.k = s.k + 1),
last AS (SELECT photo_id, arg_max(kept, k) AS kept FROM s GROUP BY 1), u AS (SELECT photo_id, unnest(kept) AS b FROM last)
SELECT photo_id, b.x AS x, b.y AS y, b.width AS width, b.height AS height, b.score AS score FROM u""")
def face_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.suppress(_boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BOXES}, t AS (SELECT photo_id, face_id, x + 2 AS x, y, width, height FROM boxes),
m AS (SELECT * FROM (SELECT f.photo_id, f.face_id AS a, t.face_id AS b, {_iou("f", "t")} AS m FROM boxes f JOIN t ON t.photo_id = f.photo_id) WHERE m >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY m DESC, a DESC, b DESC) AS k FROM m),
s(photo_id, k, left_, right_, hit, a, b, m) AS (SELECT photo_id, 1::BIGINT, [a], [b], true, a, b, m FROM r WHERE k = 1 UNION ALL
 SELECT s.photo_id, r.k, CASE WHEN ok THEN list_append(left_, r.a) ELSE left_ END, CASE WHEN ok THEN list_append(right_, r.b) ELSE right_ END, ok, r.a, r.b, r.m
FROM (SELECT *, k + 1 AS next FROM s) s JOIN r ON r.photo_id = s.photo_id AND r.k = s.next, LATERAL (SELECT NOT list_contains(left_, r.a)
 AND NOT list_contains(right_, r.b) AS ok))
SELECT photo_id, a AS found_id, b AS truth_id, round(m, 9) AS overlap FROM s WHERE hit""")
def face_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return faces.match_faces(b, b.withColumn("x", F.col("x") + 2)).withColumn("overlap", F.round("overlap", 9))


@query(f"""WITH RECURSIVE {_BOXES}, t AS (SELECT photo_id, face_id, x + 2 AS x, y, width, height, CASE WHEN face_id % 3 = 0 THEN 'closed'
 ELSE 'open' END AS status FROM boxes WHERE face_id % 5 < 4),
m AS (SELECT * FROM (SELECT f.photo_id, f.face_id AS a, t.face_id AS b, {_iou("f", "t")} AS m FROM boxes f JOIN t ON t.photo_id = f.photo_id) WHERE m >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY m DESC, a DESC, b DESC) AS k FROM m),
s(photo_id, k, left_, right_, hit, a, b) AS (SELECT photo_id, 1::BIGINT, [a], [b], true, a, b FROM r WHERE k = 1 UNION ALL
 SELECT s.photo_id, r.k, CASE WHEN ok THEN list_append(left_, r.a) ELSE left_ END, CASE WHEN ok THEN list_append(right_, r.b) ELSE right_ END, ok, r.a, r.b
FROM (SELECT *, k + 1 AS next FROM s) s JOIN r ON r.photo_id = s.photo_id AND r.k = s.next, LATERAL (SELECT NOT list_contains(left_, r.a)
 AND NOT list_contains(right_, r.b) AS ok)),
j AS (SELECT t.status AS is_, f.said FROM (SELECT photo_id, a, b FROM s WHERE hit) h FULL JOIN (SELECT photo_id, face_id, CASE face_id % 4
 WHEN 0 THEN 'closed' WHEN 1 THEN 'uncertain' ELSE 'open' END AS said FROM boxes) f
 ON f.photo_id = h.photo_id AND f.face_id = h.a FULL JOIN t ON t.photo_id = coalesce(h.photo_id, f.photo_id) AND t.face_id = h.b),
n AS (SELECT count(*) FILTER (said = 'closed' AND is_ IS NOT DISTINCT FROM 'closed') AS tp, count(*) FILTER (said = 'closed' AND is_ IS
 DISTINCT FROM 'closed') AS fp,
count(*) FILTER (is_ = 'closed' AND said IS DISTINCT FROM 'closed') AS fn, count(*) FILTER (said <> 'uncertain' AND is_ IS NOT NULL) AS
 sure, count(*) FILTER (is_ IS NOT NULL) AS eligible FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(sure / eligible::DOUBLE,
 6) AS reliable_coverage, eligible AS eligible_faces FROM n""")
def matched_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    truth = b.where("face_id % 5 < 4").withColumns({"x": F.col("x") + 2, "status": F.expr("if(face_id % 3 = 0, 'closed', 'open')")})
    found = b.withColumn("status", F.expr("case face_id % 4 when 0 then 'closed' when 1 then 'uncertain' else 'open' end"))
    e = faces.evaluation(found, truth, faces.match_faces(found, truth))
    return e.select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("reliable_coverage"), "eligible_faces")


@query("""WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id::VARCHAR AS photo_id, 'unknown' AS fault FROM a WHERE doc_id NOT IN (SELECT doc_id FROM m) UNION ALL SELECT doc_id::VARCHAR,
 'missing' FROM m WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def annotation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    photo = F.col("doc_id").cast("string").alias("photo_id")
    manifest = A.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(photo)
    return evaluation.annotation_faults(manifest, A.table(spark, sf_dir, "labels").select(photo))


# ---- refresh

_PART = "id % 10 = 0"


@query(f"""WITH {A.V_ORD}, src AS (SELECT * FROM v_ord), {_classified(BALANCED.quality)} SELECT id, CASE WHEN id % 10 = 0 THEN suggestion ELSE 'keep'
 END AS suggestion FROM classified""")
def reclassify_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.orders_as_photos(spark, sf_dir).withColumns({"suggestion": F.lit("keep"), "reason": F.lit(""), "quality_score": F.lit(0.0)})
    return quality.reclassify(photos, BALANCED, photos.where(_PART).select("id")).select("id", "suggestion")


@query(f"""WITH {A.V_ORD}, p AS (SELECT quantile_cont(sharpness, 0.06) AS sharp_remove, quantile_cont(sharpness, 0.15) AS sharp_review FROM
 v_ord WHERE status = 'active'),
src AS (SELECT * FROM v_ord, p), {_classified(PERCENT.quality, 'sharp_remove', 'sharp_review')} SELECT suggestion, count(*) AS n FROM classified GROUP BY 1""")
def reclassify_some_by_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = A.orders_as_photos(spark, sf_dir).withColumns({"suggestion": F.lit("none"), "reason": F.lit(""), "quality_score": F.lit(0.0)})
    return quality.reclassify(photos, PERCENT, photos.where(_PART).select("id")).groupBy("suggestion").agg(F.count("*").alias("n"))


@query(f"""WITH {A.V_HASH}, old AS (SELECT a_id, b_id, kind FROM (SELECT a_id, b_id, 'similar' AS kind FROM v_edges WHERE a_id % 2 = 0)),
kept AS (SELECT * FROM old WHERE a_id <> 5 AND b_id <> 5), fresh AS (SELECT a_id, b_id, 'similar' AS kind FROM v_edges WHERE a_id = 5 OR
 b_id = 5), e AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
SELECT 'edge' AS what, a_id, b_id FROM e UNION ALL SELECT 'blink', id, id FROM (SELECT a_id AS id FROM fresh UNION SELECT b_id FROM fresh)""")
def refresh_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed photo: its edges made anew, its and its neighbours' blinks looked at. The photo is the change, not a cut of the table."""
    photos, edges = _edges(spark, sf_dir)
    photos = photos.withColumns({"media_type": F.lit("image"), "thumbnail": F.lit("t")})
    plan = RefreshPlan(False, True, True, frozenset({5}))
    _, after, blinks = refresh.refresh(photos, edges.where("a_id % 2 = 0"), LOOSE, plan)
    return after.select(F.lit("edge").alias("what"), "a_id", "b_id").unionByName(blinks.select(F.lit("blink").alias("what"), F.col("id").alias("a_id"), F.col("id").alias("b_id")))
