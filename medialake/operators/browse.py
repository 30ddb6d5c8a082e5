"""Browsing: a scope, toolbar filters, an order, and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .dupes import duplicate_key
from .rules import combined, is_screenshot, is_video, stored

#: The columns a grid of pictures needs.
GRID = ("id", "uuid", "path", "filename", "width", "height", "orientation", "taken_at", "favorite", "rating", "edit_version", "thumb_state", "bytes", "duration", "has_live", "fingerprint", "place_name")


def visible(trash: bool = False, hidden: bool = False) -> Column:
    """No moving half of a live picture; in the trash or not; hidden or not."""
    trashed = F.col("trashed_at").isNotNull()
    out = F.col("paired_to").isNull() & (trashed if trash else ~trashed)
    return out & (F.coalesce(F.col("hidden"), F.lit(0)) == (1 if hidden else 0)) if not trash else out


def scope(photos: DataFrame, name: str, ids: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """The photos of a scope; ids: (id) of a selection, for the scope 'ids'; roots: (id, in_library), for
    'imports' (without them, photos have in_library). Duplicates share a duplicate_key() with another
    photo that isn't in the trash, be it hidden or half of a live picture; they get it as ``fingerprint``."""
    base = photos.where(visible(trash=name == "trash", hidden=name == "hidden"))
    flags = {"favorites": F.col("favorite") > 0, "edited": F.col("edit_version") > 0, "screenshots": is_screenshot(), "videos": is_video(), "imports": F.col("in_library") > 0}
    if name == "ids":
        return base.join(ids.select("id").distinct(), "id", "left_semi")
    if name == "duplicates":
        keyed = photos.where(F.col("trashed_at").isNull()).select(duplicate_key(photos.columns).alias("__key"))
        many = keyed.where("__key is not null").groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1").select("__key")
        return base.withColumn("__key", duplicate_key(photos.columns)).join(many, "__key", "left_semi").withColumn("fingerprint", F.col("__key")).drop("__key")
    if name == "imports" and roots is not None:
        return base.join(roots.where("in_library = 1").select(F.col("id").alias("root_id")), "root_id", "left_semi")
    return base.where(flags[name]) if name in flags else base


def in_album(photos: DataFrame, items: DataFrame, album_id: int) -> DataFrame:
    """The photos of an album, with their position in it."""
    own = items.where(F.col("album_id") == album_id).select(F.col("photo_id").alias("id"), "position")
    return photos.where(visible()).join(own, "id")


def in_folders(photos: DataFrame, items: DataFrame, albums: DataFrame, folders: DataFrame) -> DataFrame:
    """The photos of the albums in folders (id): a folder, with those below it, as folder_closure gives them."""
    of = albums.join(folders.select(F.col("id").alias("folder_id")).distinct(), "folder_id", "left_semi").select(F.col("id").alias("album_id"))
    ids = items.join(of, "album_id", "left_semi").select(F.col("photo_id").alias("id"))
    return photos.where(visible()).join(ids, "id", "left_semi")


def smart(photos: DataFrame, rules: str | None, match: str, as_of: float) -> DataFrame:
    """The photos that a saved smart album stands for; rules: its JSON text."""
    return photos.where(visible() & combined(stored(rules), match, as_of))


def in_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once; the count is aggregated before it is joined."""
    many = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    return df.join(many, key, "left_semi")


def filtered(photos: DataFrame, names: list[str], album_items: DataFrame | None = None) -> DataFrame:
    """Photos that pass any of the filters; unknown names don't count."""
    known = {"favorites": F.col("favorite") > 0, "edited": F.col("edit_version") > 0, "screenshots": is_screenshot(), "videos": is_video(), "photos": ~is_video(), "has_location": F.col("gps_lat").isNotNull(), "not_in_album": F.col("__in").isNull()}
    chosen = [known[n] for n in names if n in known]
    if not chosen:
        return photos
    if "not_in_album" in names:
        photos = photos.join(album_items.select(F.col("photo_id").alias("id")).distinct().withColumn("__in", F.lit(1)), "id", "left")
    return photos.where(reduce(lambda a, b: a | b, chosen)).drop("__in")


def ordered(photos: DataFrame, order: str) -> DataFrame:
    """Adds nothing, sorts: ties always go to the smaller id."""
    keys = {
        "manual": [F.asc_nulls_last("position")], "newest": [F.desc_nulls_last("taken_at")], "oldest": [F.asc_nulls_last("taken_at")], "added": [F.desc_nulls_last("added_at")],
        "name": [F.lower("filename")], "size": [F.desc_nulls_last("bytes")], "rating": [F.desc_nulls_last("rating"), F.desc_nulls_last("taken_at")],
    }
    return photos.orderBy(*keys[order], "id")


def group_order(photos: DataFrame, group: str, by: str) -> DataFrame:
    """Adds ``group_first``, the least value of ``by`` in a group, to sort groups by."""
    return photos.withColumn("group_first", F.min(by).over(Window.partitionBy(group)))


def page_after(photos: DataFrame, taken_at: float | None, last_id: int | None, size: int) -> DataFrame:
    """The next page, newest first, after the last row of the page before: no offset is counted."""
    if last_id is not None:
        photos = photos.where((F.col("taken_at") < taken_at) | ((F.col("taken_at") == taken_at) & (F.col("id") > last_id)))
    return photos.where(F.col("taken_at").isNotNull()).orderBy(F.desc("taken_at"), "id").limit(size)
