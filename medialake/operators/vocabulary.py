"""What a library can be searched for: its people, places, cameras, albums and folders, with how often."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

#: The order of kinds among suggestions.
KINDS = ("person", "place", "camera", "album", "folder", "event")
MOST_CAMERAS = 400


def counted(rows: DataFrame, column: str, kind: str, most: int | None = None) -> DataFrame:
    """(kind, text, uses) of the values of a column; most: only the most used ones."""
    out = rows.where(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.trim(column).alias("text")).agg(F.count("*").alias("uses"))
    out = out.select(F.lit(kind).alias("kind"), "text", "uses")
    return out.orderBy(F.desc("uses"), "text").limit(most) if most else out


def vocabulary(photos: DataFrame, people: DataFrame, placed: DataFrame, albums: DataFrame) -> DataFrame:
    """(kind, text, uses, folded): all words that searches can name.

    photos: camera_model, path; people: name; placed: city, region, country; albums: name.
    """
    folders = photos.select(F.element_at(F.split("path", "/"), -2).alias("folder"))
    parts = [counted(people, "name", "person"), counted(photos, "camera_model", "camera", MOST_CAMERAS), counted(albums, "name", "album"), counted(folders, "folder", "folder")]
    parts += [counted(placed, c, "place") for c in ("city", "region", "country")]
    both = reduce(DataFrame.unionByName, parts).groupBy("kind", "text").agg(F.sum("uses").alias("uses"))
    return both.withColumn("folded", folded(F.col("text")))


def suggestions(words: DataFrame, typed: str, k: int = 8) -> DataFrame:
    """The k best completions of what is typed: texts that start with it, then texts with a word that does."""
    start = F.startswith("folded", folded(F.lit(typed)))
    inner = F.contains("folded", folded(F.lit(" " + typed)))
    rank = F.element_at(F.create_map(*(x for i, n in enumerate(KINDS) for x in (F.lit(n), F.lit(i)))), F.col("kind"))
    return words.where(start | inner).orderBy(start.cast("int").desc(), rank, F.desc("uses"), "text").limit(k).select("kind", "text", "uses")
