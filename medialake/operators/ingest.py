"""Taking files in: what to scan, what moved, what wins, and where roots lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_from_folders, date_from_name, epoch

MTIME_SLACK_S = 0.001


def stale(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files (path, bytes, mtime) to read again: unknown, of another size or time, or without dimensions."""
    k = known.select("path", F.col("bytes").alias("k_bytes"), F.col("mtime").alias("k_mtime"), F.col("width").alias("k_width"), F.col("height").alias("k_height"))
    again = F.col("k_bytes").isNull() | (F.col("bytes") != F.col("k_bytes")) | (F.abs(F.col("mtime") - F.col("k_mtime")) > MTIME_SLACK_S) | F.col("k_mtime").isNull() | (F.coalesce("k_width", F.lit(0)) == 0) | (F.coalesce("k_height", F.lit(0)) == 0)
    return listing.join(k, "path", "left").where(again).select(*listing.columns)


def moved(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state, new_path) of known files that a full listing lacks: moved, if a listed file has the
    same fingerprint (the first path wins), else missing."""
    gone = known.join(listing.select("path"), "path", "left_anti").select("path", "fingerprint")
    here = listing.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("path").alias("new_path"))
    return gone.join(here, "fingerprint", "left").select("path", F.when(F.col("new_path").isNull(), "missing").otherwise("moved").alias("state"), "new_path")


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The scan table after new readings: by path, new facts replace old ones.

    Kept: a date set by hand; a recorded date against one from the folder or the file's time; a place
    set by hand (gps_manual 1). Both tables: path, bytes, mtime, taken_at, date_source, gps_lat, gps_lon, gps_manual.
    """
    old = stored.select("path", *(F.col(c).alias("o_" + c) for c in stored.columns if c != "path"))
    joined = incoming.join(old, "path", "full")
    new, was = F.col("mtime").isNotNull() | F.col("bytes").isNotNull(), F.col("o_mtime").isNotNull() | F.col("o_bytes").isNotNull()
    weak = F.coalesce(F.col("date_source").isin("folder", "mtime"), F.lit(True))
    keep_date = was & (~new | F.coalesce((F.col("o_date_source") == "manual") | ((F.col("o_date_source") == "recorded") & weak), F.lit(False)))
    keep_gps = was & (~new | (F.coalesce("o_gps_manual", F.lit(0)) == 1))
    pick = lambda keep, c: F.when(keep, F.col("o_" + c)).otherwise(F.col(c)).alias(c)
    return joined.select("path", *(pick(~new, c) for c in ("bytes", "mtime")), pick(keep_date, "taken_at"), pick(keep_date, "date_source"), pick(keep_gps, "gps_lat"), pick(keep_gps, "gps_lon"), F.when(was, F.coalesce("o_gps_manual", F.lit(0))).otherwise(F.coalesce("gps_manual", F.lit(0))).alias("gps_manual"))


def outer_roots(roots: DataFrame) -> DataFrame:
    """(path, root): each root with the outermost one that holds it, by its parent folders."""
    parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
    above = roots.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    held = roots.select(F.rtrim(F.col("path"), F.lit("/")).alias("up")).distinct()
    return above.join(held, "up").groupBy("path").agg(F.min_by("up", F.length("up")).alias("root"))


def removed_filter(listing: DataFrame, removed: DataFrame) -> DataFrame:
    """Files that nobody took out of the library on purpose."""
    return listing.join(removed.select("path").distinct(), "path", "left_anti")


def expired(photos: DataFrame, as_of: float, days: float = 30.0) -> DataFrame:
    """(path) of what lay in the trash for longer than ``days``."""
    return photos.where(F.col("trashed_at") < as_of - days * 86_400).select("path")


def dated(files: DataFrame, last_year: int) -> DataFrame:
    """Adds taken_at and date_source of files without a recorded date: from the name, the nearest dated
    folder (noon, unless the file's time is that day), else the file's time."""
    name, folder = date_from_name("filename", last_year), date_from_folders("path")
    start = lambda d: epoch(d.cast("timestamp_ntz")).cast("double")
    same_day = (F.col("mtime") >= start(folder)) & (F.col("mtime") < start(folder) + 86_400)
    by_folder = F.when(same_day, F.col("mtime")).otherwise(start(folder) + 43_200)
    at = F.coalesce(F.col("taken_at"), start(name), by_folder, F.col("mtime"))
    source = F.when(F.col("taken_at").isNotNull(), F.col("date_source")).when(name.isNotNull(), "filename").when(folder.isNotNull(), "folder").otherwise("mtime")
    return files.withColumns({"taken_at": at, "date_source": source})


def relocated(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths below ``old`` as paths below ``new``."""
    from .merge import adopted

    return adopted(df, column, old, new)


def new_items(listing: DataFrame, photos: DataFrame) -> DataFrame:
    """Listed files of a device whose fingerprint the library lacks, one per fingerprint (first path)."""
    fresh = listing.join(photos.select("fingerprint").distinct(), "fingerprint", "left_anti")
    first = Window.partitionBy("fingerprint").orderBy("path")
    return fresh.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def date_repair(photos: DataFrame, last_year: int) -> DataFrame:
    """Photos dated by their file's time, dated again by name or folder."""
    known = F.col("date_source") != "mtime"
    again = dated(photos.withColumn("taken_at", F.when(known, F.col("taken_at"))), last_year)
    return again


def kept_pieces(start: Column, end: Column, cuts: Column, least: float = 1 / 60) -> Column:
    """array<struct<a,b>>: what is left of [start, end] without the cuts (array<struct<a,b>>), pieces of at least ``least``."""
    state = F.aggregate(
        F.array_sort(cuts),
        F.struct(F.array().cast("array<struct<a:double,b:double>>").alias("out"), start.cast("double").alias("at")),
        lambda s, c: F.struct(F.when(c["a"] - s["at"] >= least, F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), F.least(c["a"], end.cast("double")).alias("b"))))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], c["b"]).alias("at")),
    )
    last = F.struct(state["at"].alias("a"), end.cast("double").alias("b"))
    pieces = F.when(end - state["at"] >= least, F.concat(state["out"], F.array(last))).otherwise(state["out"])
    return F.filter(pieces, lambda p: p["b"] - p["a"] >= least)
