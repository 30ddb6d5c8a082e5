"""The media model: scanned facts, user marks and derived values, each a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Schemas in DDL, as readers and createDataFrame take them.
MEDIA_SCAN = (
    "path string not null, root_id long, filename string, ext string, bytes long, mtime double, width int, height int, fingerprint string, taken_at double, date_source string, "
    "camera_make string, camera_model string, lens string, iso int, f_number double, exposure double, focal_length double, gps_lat double, gps_lon double, duration double, added_at double"
)
MEDIA_USER = "path string not null, favorite int, rating int, hidden int, trashed_at double, edit_version int, title string, caption string, keywords string, place_name string, modified_at double"
ALBUMS = "id long, uuid string, name string, folder_id long, cover_id long, created_at double, position int"
ALBUM_ITEMS = "album_id long, photo_id long, position long"
FOLDERS = "id long, uuid string, name string, parent_id long, position int"
FACES = "id long, photo_id long, person_id long, state int, emb array<float>, yaw double, roll double, score double, px double"
PLACES = "id long, name string, region string, country string, lat double, lon double, population long"
EVENTS = "id long, start_at double, end_at double, items long, place string, custom int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
