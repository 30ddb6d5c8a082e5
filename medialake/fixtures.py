"""The driver's star-schema tables seen as media tables, in Spark and, with the same expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import table

_SECONDS = {"spark": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})", "sql": "CAST(floor(epoch({0})) AS BIGINT)"}
_YEAR = {"spark": "CAST(year({0}) AS STRING)", "sql": "CAST(year({0}) AS VARCHAR)"}

#: Photos of orders: column -> expression in the common part of both dialects; {s} seconds and {y} year of the order.
PHOTOS = {
    "id": "o_orderkey",
    "ext": "CASE o_orderkey % 40 WHEN 7 THEN 'qt' WHEN 17 THEN '3g2' WHEN 27 THEN 'OGV' WHEN 37 THEN 'flv' WHEN 8 THEN 'webm' WHEN 18 THEN 'm2ts' ELSE CASE o_orderkey % 10 WHEN 0 THEN 'mp4' WHEN 1 THEN 'png' WHEN 2 THEN 'heic' WHEN 3 THEN 'MOV' ELSE 'jpg' END END",
    "filename": "CASE WHEN o_orderkey % 17 = 0 THEN 'Screenshot_' WHEN o_orderkey % 19 = 0 THEN 'ScreenCapture ' WHEN o_orderkey % 23 = 1 THEN 'Captura de pantalla ' WHEN o_orderkey % 13 = 5 THEN 'Screen Shot ' WHEN o_orderkey % 13 = 6 THEN 'screen_shot_' ELSE 'IMG_' END || CAST(o_orderkey AS {text}) || CASE o_orderkey % 10 WHEN 0 THEN '.mp4' WHEN 1 THEN '.png' WHEN 2 THEN '.heic' WHEN 3 THEN '.MOV' ELSE '.jpg' END",
    "path": "'/lib/' || {y} || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'clip' ELSE 'still' END || CAST(o_orderkey - o_orderkey % 2 AS {text}) || CASE o_orderkey % 10 WHEN 0 THEN '.mp4' WHEN 1 THEN '.png' WHEN 2 THEN '.heic' WHEN 3 THEN '.MOV' ELSE '.jpg' END",
    "bytes": "CAST(floor(o_totalprice * 100) AS BIGINT)",
    "mtime": "CAST({s} + 5 AS DOUBLE)",
    "taken_at": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST({s} + o_orderkey * 7919 % 86400 AS DOUBLE) END",
    "added_at": "CAST({s} + 1000000 AS DOUBLE)",
    "favorite": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END",
    "hidden": "CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END",
    "trashed_at": "CASE WHEN o_orderkey % 31 = 0 THEN CAST(1700000000 AS DOUBLE) END",
    "edit_version": "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END",
    "rating": "CAST(o_orderkey % 6 AS INTEGER)",
    "width": "CAST(1000 + o_orderkey % 7 * 500 AS INTEGER)",
    "height": "CAST(1000 + o_orderkey % 5 * 500 AS INTEGER)",
    "gps_lat": "CASE WHEN o_orderkey % 99 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 140 - 70 AS DOUBLE) + CAST(o_orderkey % 4 AS DOUBLE) / 4 END",
    "gps_lon": "CASE WHEN o_orderkey % 99 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 340 - 170 AS DOUBLE) END",
    "fingerprint": "'f' || CAST(o_orderkey % 4001 AS {text})",
    "camera_model": "CASE o_orderkey % 4 WHEN 0 THEN 'Canon EOS' WHEN 1 THEN 'NIKON D5' WHEN 2 THEN 'sony a7' END",
    "in_library": "CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END",
    "paired_to": "CASE WHEN o_orderkey % 37 = 0 THEN o_orderkey END",
    "duration": "CASE WHEN o_orderkey % 10 IN (0, 3) THEN CAST(o_orderkey % 600 AS DOUBLE) / 100 END",
    "album": "o_custkey",
    "root_id": "CAST(o_custkey % 5 AS BIGINT)",
    "look_key": "CASE WHEN o_orderkey % 3 = 0 THEN 'look' || CAST(o_orderkey % 701 AS {text}) END",
    "looked_bytes": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice * 100) AS BIGINT) ELSE 0 END",
    "looked_mtime": "CAST({s} + 5 AS DOUBLE)",
    "content_hash": "'content' || CAST(o_orderkey % 901 AS {text})",
    "hashed_bytes": "CAST(floor(o_totalprice * 100) AS BIGINT)",
    "hashed_mtime": "CASE WHEN o_orderkey % 5 = 0 THEN CAST({s} + 5 AS DOUBLE) END",
    "thumb_state": "CAST(o_orderkey % 4 AS INTEGER)",
}


def _filled(text: str, dialect: str) -> str:
    return text.replace("{s}", _SECONDS[dialect].format("o_orderdate")).replace("{y}", _YEAR[dialect].format("o_orderdate")).replace("{text}", "STRING" if dialect == "spark" else "VARCHAR")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*(F.expr(_filled(e, "spark")).alias(n) for n, e in PHOTOS.items()))


#: The same as common table expressions: photos, albums, items.
PHOTOS_SQL = "photos AS (SELECT " + ", ".join(f"{_filled(e, 'sql')} AS {n}" for n, e in PHOTOS.items()) + " FROM orders)"
ALBUMS_SQL = "albums AS (SELECT c_custkey AS id, c_nationkey AS folder_id, CASE WHEN c_custkey % 11 = 0 THEN c_custkey * 10 END AS cover_id FROM customer), items AS (SELECT o_custkey AS album_id, o_orderkey AS photo_id, o_orderkey * 13 % 101 AS position FROM orders)"
MOMENTS_SQL = "moments AS (SELECT user_id, event_id AS id, floor(epoch(ts)) AS taken_at, CASE WHEN event_id % 5 > 0 THEN event_type END AS city, CASE WHEN event_id % 6 = 0 THEN 'mp4' ELSE 'jpg' END AS ext, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS favorite, CAST(event_id % 6 AS INTEGER) AS rating, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events)"
VECTORS_SQL = "faces AS (SELECT vec_id AS id, vec_id % 300 AS photo_id, CASE WHEN vec_id % 4 > 0 THEN label END AS person_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS u, embedding FROM embeddings)"


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("folder_id"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN c_custkey * 10 END AS cover_id"))


def album_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("photo_id"), F.expr("o_orderkey * 13 % 101 AS position"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pictures of users; the event's type stands for the city, unknown for every fifth."""
    seconds = F.expr(f"CAST({_SECONDS['spark'].format('ts')} AS DOUBLE)").alias("taken_at")
    rest = ("CASE WHEN event_id % 5 > 0 THEN event_type END AS city", "CASE WHEN event_id % 6 = 0 THEN 'mp4' ELSE 'jpg' END AS ext", "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS favorite", "CAST(event_id % 6 AS INT) AS rating", "CAST(floor(value * 100) AS BIGINT) AS bytes")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), seconds, *map(F.expr, rest))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id % 300 AS photo_id"), F.expr("CASE WHEN vec_id % 4 > 0 THEN label END AS person_id"), F.col("embedding").alias("emb"), "embedding")
