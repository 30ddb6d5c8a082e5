"""What a search term stands for: predicates and semi joins of people, places, folders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

#: A moment counts up to this long after the end of an event.
END_SLACK_S = 0.001


def of_people(photos: DataFrame, faces: DataFrame, people: list[int], without: bool = False) -> DataFrame:
    """Photos with a face of any of these people (or with none): faces that the user didn't remove (state below 2)."""
    theirs = faces.where(F.col("person_id").isin(people) & (F.col("state") < 2)).select(F.col("photo_id").alias("id"))
    return photos.join(theirs, "id", "left_anti" if without else "left_semi")


def with_all_people(photos: DataFrame, faces: DataFrame, people: list[list[int]]) -> DataFrame:
    """Photos in which every one of several people is; each is a list of ids, as names can be shared."""
    return reduce(lambda rows, ids: of_people(rows, faces, ids), people, photos)


def at_place(photos: DataFrame, placed: DataFrame, column: str, name: str) -> DataFrame:
    """Photos whose city, region or country (column) is called so, regardless of case and accents. placed: photo_id and names."""
    there = placed.where(folded(F.col(column)) == folded(F.lit(name))).select(F.col("photo_id").alias("id"))
    return photos.join(there, "id", "left_semi")


def in_disk_folder(name: str, path: str = "path") -> Column:
    """Whether a folder of that name is somewhere on the path, regardless of case and accents; not a part of a name."""
    return F.contains(folded(F.col(path)), folded(F.lit(f"/{name}/")))


def in_events(spans: list[tuple[float, float]], c: str = "taken_at") -> Column:
    """Whether a moment is in any of an event's spans: from the start on, up to just after the end."""
    return reduce(lambda a, b: a | b, ((F.col(c) >= lo) & (F.col(c) < hi + END_SLACK_S) for lo, hi in spans), F.lit(False))


def folder_only(words: DataFrame, typed: str) -> DataFrame:
    """(kind, text): the one folder or album that what is typed stands for as a whole; none, if it names anything else too.

    words: (kind, text, folded), the vocabulary."""
    hit = words.where(F.col("folded") == folded(F.lit(typed.strip())))
    other = hit.where(~F.col("kind").isin("folder", "album")).select("folded").distinct()
    return hit.where(F.col("kind").isin("folder", "album")).join(other, "folded", "left_anti").select("kind", "text")


def without_term(terms: DataFrame, position: int) -> DataFrame:
    """(position, text): the terms of a search but the one taken away, numbered anew; taking a chip away."""
    left = terms.where(F.col("position") != position)
    return left.select((F.col("position") - (F.col("position") > position).cast("int")).alias("position"), "text")


def of_kind(words: DataFrame, name: str, kind: str) -> DataFrame:
    """The meanings of a name that are of one kind, or all of them if none is: 'album: x' and 'folder: x'."""
    hit = words.where(F.col("folded") == folded(F.lit(name))).withColumn("__own", (F.col("kind") == kind).cast("int"))
    most = hit.groupBy("folded").agg(F.max("__own").alias("__most"))
    return hit.join(most, "folded").where(F.col("__own") == F.col("__most")).select("kind", "text", "uses")
