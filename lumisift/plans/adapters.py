"""Photo-shaped views of the given tables, each with its SQL twin; integer or IEEE-exact arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_as_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.selectExpr(
        "doc_id as id", "concat(source, '/', lang, '/', cast(doc_id as string), '.jpg') as relative_path", "n_chars as size", "sha2(text, 256) as sha256", "'' as motion_sha256",
        "case when toxic = 1 then 'remove' when quality = 1 then 'keep' else '' end as decision",
        "case when doc_id % 17 = 0 then 'missing' else 'active' end as status", "case when doc_id % 23 = 0 then 'decode' else '' end as error",
        "element_at(array('keep', 'review', 'remove', 'unreadable'), cast(doc_id % 4 as int) + 1) as suggestion", "cast(doc_id * 1.5D as double) as mtime",
        "case when doc_id % 5 = 0 then '' else concat('thumbs/', cast(doc_id as string)) end as thumbnail", "'image' as media_type",
        "cast((doc_id * 7) % 1000 as double) as sharpness", "cast((doc_id * 37) % 256 as double) as luminance", "cast(40 as double) as contrast", "0D as dark_clip", "0D as bright_clip", "6D as entropy", "2D as megapixels", "text",
        "if(doc_id % 3 = 0, 'apple_sidecar', '') as motion_kind", "if(doc_id % 6 = 0, concat(cast(doc_id as string), '.mov'), concat(source, '/', lang, '/', cast(doc_id as string), '.jpg')) as motion_relative_path", "doc_id % 1000 as motion_size",
    )


V_DOC = """v_doc AS (SELECT d.doc_id AS id, concat(source, '/', lang, '/', d.doc_id::VARCHAR, '.jpg') AS relative_path, n_chars AS size,
 sha256(text) AS sha256, '' AS motion_sha256,
  CASE WHEN toxic = 1 THEN 'remove' WHEN quality = 1 THEN 'keep' ELSE '' END AS decision,
  CASE WHEN d.doc_id % 17 = 0 THEN 'missing' ELSE 'active' END AS status, CASE WHEN d.doc_id % 23 = 0 THEN 'decode' ELSE '' END AS error,
  (['keep', 'review', 'remove', 'unreadable'])[d.doc_id % 4 + 1] AS suggestion, (d.doc_id * 1.5)::DOUBLE AS mtime,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE concat('thumbs/', d.doc_id::VARCHAR) END AS thumbnail, 'image' AS media_type,
((d.doc_id * 7) % 1000)::DOUBLE AS sharpness, ((d.doc_id * 37) % 256)::DOUBLE AS luminance, 40::DOUBLE AS contrast, 0::DOUBLE AS dark_clip,
 0::DOUBLE AS bright_clip, 6::DOUBLE AS entropy, 2::DOUBLE AS megapixels, text,
  CASE WHEN d.doc_id % 3 = 0 THEN 'apple_sidecar' ELSE '' END AS motion_kind,
CASE WHEN d.doc_id % 6 = 0 THEN concat(d.doc_id::VARCHAR, '.mov') ELSE concat(source, '/', lang, '/', d.doc_id::VARCHAR, '.jpg') END AS
 motion_relative_path, d.doc_id % 1000 AS motion_size
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def orders_as_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "o_totalprice / 500 as sharpness", "cast((o_orderkey * 37) % 256 as double) as luminance", "cast(10 + (o_orderkey * 13) % 90 as double) as contrast",
        "((o_orderkey * 7) % 100) / 100D as dark_clip", "((o_orderkey * 11) % 70) / 100D as bright_clip", "3 + ((o_orderkey * 3) % 50) / 10D as entropy", "(o_orderkey % 120) / 10D as megapixels",
        "(o_orderkey % 97) * 4096 as size", "case when o_orderkey % 53 = 0 then 'decode' else '' end as error", "case when o_orderkey % 17 = 0 then 'missing' else 'active' end as status",
        "case when o_orderkey % 29 = 0 then 'motion' else 'still' end as cover_source", "o_orderdate as taken", "o_custkey as dir",
    )


V_ORD = """v_ord AS (SELECT o_orderkey AS id, o_totalprice / 500 AS sharpness, ((o_orderkey * 37) % 256)::DOUBLE AS luminance, (10 +
 (o_orderkey * 13) % 90)::DOUBLE AS contrast,
((o_orderkey * 7) % 100)::DOUBLE / 100 AS dark_clip, ((o_orderkey * 11) % 70)::DOUBLE / 100 AS bright_clip, 3 + ((o_orderkey * 3) %
 50)::DOUBLE / 10 AS entropy, (o_orderkey % 120)::DOUBLE / 10 AS megapixels,
(o_orderkey % 97) * 4096 AS size, CASE WHEN o_orderkey % 53 = 0 THEN 'decode' ELSE '' END AS error, CASE WHEN o_orderkey % 17 = 0 THEN
 'missing' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 29 = 0 THEN 'motion' ELSE 'still' END AS cover_source, o_orderdate AS taken, o_custkey AS dir FROM orders)"""


def vectors_as_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "label", "transform(embedding, e -> cast(greatest(0, least(255, floor((cast(e as double) + 0.6D) * 212.5D))) as int)) as gray")


V_PX = """v_px AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 0.6::DOUBLE) *
 212.5::DOUBLE)))::INTEGER) AS gray FROM embeddings),
x_px AS (SELECT id, unnest(gray) AS v, unnest(range(64)) AS i FROM v_px)"""


def vectors_as_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")

    def bits(test: str) -> str:
        return f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if({test}, shiftleft(1L, 63 - i), 0L))"

    rows = e.selectExpr("vec_id as id", "cast(label as string) as dir", f"{bits('embedding[i] > 0')} as phash", f"{bits('embedding[(i + 1) % 64] > embedding[i]')} as dhash", "cast(embedding as array<double>) as v")
    return rows.withColumn("structure", S.centred(F.col("v"))).drop("v").withColumns({
        "position": F.col("id"), "width": F.lit(1200), "height": F.lit(800) + F.col("id") % 200, "relative_path": F.concat(F.col("dir"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")),
        "sharpness": ((F.col("id") * 7) % 100).cast("double"), "luminance": F.lit(110.0), "contrast": F.lit(40.0), "dark_clip": F.lit(0.0), "bright_clip": F.lit(0.0), "entropy": F.lit(6.0), "megapixels": F.lit(2.0),
        "status": F.lit("active"), "error": F.lit(""), "sha256": F.lit(""), "motion_sha256": F.lit(""), "taken": F.lit(""), "decision": F.lit(""),
        "blink_status": F.element_at(F.array(F.lit("open"), F.lit("closed"), F.lit("uncertain")), (F.col("id") % 3).cast("int") + 1), "blink_face_count": F.lit(2), "blink_uncertain_face_count": F.lit(0),
        "blink_closed_face_count": F.when(F.col("id") % 3 == 1, 1).otherwise(0), "blink_closed_ratio": F.when(F.col("id") % 3 == 1, 0.5).otherwise(0.0),
    })


_BITS = "list_reduce(list_transform(range(64), lambda i: CASE WHEN {test} THEN (1::HUGEINT << (63 - i)::INTEGER)::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a | b)"
V_HASH = f"""v_hash0 AS (SELECT vec_id AS id, label::VARCHAR AS dir, embedding::DOUBLE[] AS v, (vec_id * 7) % 100 AS sharp, 1200::DOUBLE /
 (800 + vec_id % 200) AS aspect,
  {_BITS.format(test='embedding[i + 1] > 0')} AS phash,
  {_BITS.format(test='embedding[(i + 1) % 64 + 1] > embedding[i + 1]')} AS dhash FROM embeddings),
v_hash AS (SELECT *, list_transform(v, lambda x: x - list_sum(v) / 64) AS s FROM v_hash0),
v_pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.sharp AS a_sharp, b.sharp AS b_sharp, a.aspect AS a_aspect, b.aspect AS b_aspect, a.s AS
 a_s, b.s AS b_s, bit_count(xor(a.phash, b.phash)) AS ph, bit_count(xor(a.dhash, b.dhash)) AS dh
  FROM v_hash a JOIN v_hash b ON a.dir = b.dir AND a.id < b.id WHERE bit_count(xor(a.phash, b.phash)) <= 24 AND bit_count(xor(a.dhash, b.dhash)) <= 30),
v_scored AS (SELECT *, list_sum(list_transform(list_zip(a_s, b_s), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a_s, lambda x: x
 * x))) * sqrt(list_sum(list_transform(b_s, lambda x: x * x)))) AS st
  FROM v_pairs WHERE abs(a_aspect - b_aspect) <= 0.11 * greatest(a_aspect, b_aspect)),
v_edges AS (SELECT a_id, b_id, 0.45 * (1 - ph / 64.0::DOUBLE) + 0.25 * (1 - dh / 64.0::DOUBLE) + 0.30 * st AS score, CASE WHEN a_sharp >=
 b_sharp THEN a_id ELSE b_id END AS recommended_id FROM v_scored WHERE st >= 0.2)"""


def events_as_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id as dir", "event_id as sequence", "ts as taken", "row_number() over (partition by user_id order by event_id) as position")


V_SHOT = """v_shot AS (SELECT event_id AS id, user_id AS dir, event_id AS sequence, ts AS taken, row_number() OVER (PARTITION BY user_id ORDER BY
 event_id) AS position FROM events)"""


def events_as_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as photo_id", "event_id as face_id", "0.5D + (event_id % 50) / 100D as face_score", "event_id % 40 as eye_distance", "((event_id * 31) % 101) / 100D as p_right", "((event_id * 17) % 101) / 100D as p_left")


V_FACE = """v_face AS (SELECT user_id AS photo_id, event_id AS face_id, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100 AS face_score, event_id
 % 40 AS eye_distance, ((event_id * 31) % 101)::DOUBLE / 100 AS p_right, ((event_id * 17) % 101)::DOUBLE / 100 AS p_left FROM events),
v_state AS (SELECT *, CASE WHEN eye_distance >= 12 AND 1 - least(p_right, p_left) >= 0.85 THEN 'closed' WHEN eye_distance >= 12 AND
 least(p_right, p_left) >= 0.80 THEN 'open' ELSE 'uncertain' END AS state FROM v_face),
v_sure AS (SELECT *, CASE state WHEN 'closed' THEN least(face_score, 1 - least(p_right, p_left)) WHEN 'open' THEN least(face_score,
 least(p_right, p_left)) END AS evidence FROM v_state)"""
