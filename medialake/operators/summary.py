"""Counts, period summaries, album and folder roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period
from ..functions.geo import located
from ..shared import saved
from .rules import is_screenshot, is_video


def sidebar_counts(photos: DataFrame) -> DataFrame:
    """One row: how many pictures each entry of the sidebar shows, and the bytes of all rows."""
    shown = F.col("trashed_at").isNull() & F.col("paired_to").isNull()
    live = shown & (F.coalesce(F.col("hidden"), F.lit(0)) == 0)

    def n(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    return photos.agg(
        n(live, "library"), n(live & (F.col("favorite") > 0), "favorites"), n(shown & (F.col("edit_version") > 0), "edited"), n(shown & (F.col("hidden") > 0), "hidden"),
        n(live & is_screenshot(), "screenshots"), n(live & is_video(), "videos"), n(live & located("gps_lat", "gps_lon"), "located"), n(F.col("trashed_at").isNotNull(), "trash"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def period_summary(photos: DataFrame, unit: str, zone: str = "UTC") -> DataFrame:
    """period, items, first, last of each year or month."""
    dated = photos.where(F.col("taken_at").isNotNull()).select(period(F.col("taken_at"), unit, zone).alias("period"), "taken_at")
    return dated.groupBy("period").agg(F.count("*").alias("items"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last"))


def period_top(photos: DataFrame, unit: str, k: int = 4, zone: str = "UTC") -> DataFrame:
    """The k best pictures of each period: favourites, then the newest. Spark limits each group before its shuffle."""
    dated = photos.where(F.col("taken_at").isNotNull()).withColumn("period", period(F.col("taken_at"), unit, zone))
    best = Window.partitionBy("period").orderBy(F.desc("favorite"), F.desc("taken_at"), "id")
    return dated.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("period", "place", "id")


def album_rollup(albums: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    """id, items, placed, lat_span, lon_span, cover_id (the given one, else the first by position) of every album."""
    live = photos.where(F.col("trashed_at").isNull() & F.col("paired_to").isNull())
    place = located("gps_lat", "gps_lon")
    rows = items.join(live.select(F.col("id").alias("photo_id"), "gps_lat", "gps_lon"), "photo_id")
    at = lambda c: F.when(place, F.col(c))
    sums = rows.groupBy("album_id").agg(
        F.count("*").alias("items"), F.count_if(place).alias("placed"), (F.max(at("gps_lat")) - F.min(at("gps_lat"))).alias("lat_span"), (F.max(at("gps_lon")) - F.min(at("gps_lon"))).alias("lon_span"), F.min(F.struct("position", "photo_id")).alias("head")
    )
    joined = albums.join(sums, albums["id"] == sums["album_id"], "left")
    return joined.select("id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("placed", F.lit(0)).alias("placed"), "lat_span", "lon_span", F.coalesce("cover_id", "head.photo_id").alias("cover_id"))


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, id) of a forest of (id, parent_id), each node its own ancestor too.

    Each round doubles the length of the paths, so depth d takes log2(d) joins; a cycle is an error.
    """
    pairs = saved(nodes.select("id", "parent_id"))
    jump = pairs.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("up"))
    reach = saved(pairs.select(F.col("id").alias("ancestor"), "id").union(jump.select(F.col("up").alias("ancestor"), "id")))
    for _ in range(40):
        if jump.limit(1).count() == 0:
            return reach.distinct()
        step = jump.select(F.col("id").alias("mid"), F.col("up").alias("next"))
        jump = saved(jump.join(step, F.col("up") == F.col("mid")).select("id", F.col("next").alias("up")))
        if jump.where("id = up").limit(1).count():
            raise ValueError("a folder stands inside itself")
        further = jump.select(F.col("up").alias("top"), F.col("id").alias("via"))
        reach = saved(reach.union(reach.join(further, F.col("ancestor") == F.col("via")).select(F.col("top").alias("ancestor"), "id")).distinct())
    raise ValueError("folders are nested too deep")


def tree_rollup(folders: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, total): the items of each folder and all below it; counts: (folder_id, items)."""
    own = counts.groupBy("folder_id").agg(F.sum("items").alias("items"))
    under = closure(folders).join(own, F.col("id") == F.col("folder_id"), "left").groupBy("ancestor").agg(F.coalesce(F.sum("items"), F.lit(0)).alias("total"))
    return under.select(F.col("ancestor").alias("id"), "total")


def may_move(folders: DataFrame, folder: int, target: int) -> bool:
    """Whether a folder can go into another one: not into itself nor into what it holds."""
    return closure(folders).where((F.col("ancestor") == folder) & (F.col("id") == target)).limit(1).count() == 0
