"""Merging copies of a library: the last writer wins, removals are remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .people import matched_boxes


def membership(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(album, item) of the merged albums, from (album, item, added, removed) of both copies.

    An item stays if its last addition isn't before its last removal.
    """
    both = mine.unionByName(theirs).groupBy("album", "item").agg(F.max("added").alias("added"), F.max("removed").alias("removed"))
    return both.where(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("added") >= F.col("removed")))).select("album", "item")


def latest(mine: DataFrame, theirs: DataFrame, key: str, at: str = "modified_at") -> DataFrame:
    """For each key the row that changed last; a tie goes to mine."""
    columns = [c for c in mine.columns if c != key]
    both = mine.withColumn("__mine", F.lit(1)).unionByName(theirs.withColumn("__mine", F.lit(0)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(F.col(at), F.lit(float("-inf"))), "__mine")).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def with_deletions(rows: DataFrame, deleted: DataFrame, key: str, at: str = "modified_at") -> DataFrame:
    """Rows that changed after their deletion (key, deleted_at), if there is one; a tie deletes."""
    last = deleted.groupBy(key).agg(F.max("deleted_at").alias("deleted_at"))
    return rows.join(last, key, "left").where(F.col("deleted_at").isNull() | (F.col(at) > F.col("deleted_at"))).drop("deleted_at")


def marks(mine: DataFrame, theirs: DataFrame, cleared: DataFrame) -> DataFrame:
    """Favourite and rating of each path after the last change; a later or equal clearing (path, deleted_at) drops them."""
    return with_deletions(latest(mine, theirs, "path"), cleared, "path")


def newest_times(mine: DataFrame, theirs: DataFrame, key: str, at: str) -> DataFrame:
    return mine.select(key, at).unionByName(theirs.select(key, at)).groupBy(key).agg(F.max(at).alias(at))


def converted(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, size, at, older): the last conversion of each path, and the other sizes it had."""
    both = mine.unionByName(theirs)
    best = both.groupBy("path").agg(F.max(F.struct("at", "size")).alias("b"), F.collect_set("size").alias("sizes"))
    return best.select("path", F.col("b.size").alias("size"), F.col("b.at").alias("at"), F.array_sort(F.array_except("sizes", F.array("b.size"))).alias("older"))


def adopted(df: DataFrame, column: str, theirs: str, mine: str) -> DataFrame:
    """Paths of another library's root as paths of mine; other paths stay."""
    root = theirs.rstrip("/") + "/"
    inside = F.startswith(column, F.lit(root)) | (F.col(column) == theirs.rstrip("/"))
    return df.withColumn(column, F.when(inside, F.concat(F.lit(mine.rstrip("/")), F.substring(F.col(column), len(root), 1_000_000))).otherwise(F.col(column)))


def changes(before: DataFrame, after: DataFrame, key: str, at: float) -> DataFrame:
    """(key, added, removed) between two states, stamped with the time ``at``."""
    a, b = before.select(key).distinct().withColumn("__a", F.lit(1)), after.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), at).alias("added"), F.when(F.col("__b").isNull(), at).alias("removed"))


def guarded(mine: DataFrame, theirs: DataFrame, list_key: str) -> DataFrame:
    """Their lists, but mine where theirs is empty, mine isn't, and there is no history of a removal.

    Columns: list_key, items (array), history (count).
    """
    t = theirs.select(list_key, F.col("items").alias("t"), F.col("history").alias("h"))
    joined = mine.select(list_key, F.col("items").alias("m")).join(t, list_key, "full")
    empty = (F.coalesce(F.size("t"), F.lit(0)) <= 0) & (F.coalesce("h", F.lit(0)) == 0)
    return joined.select(list_key, F.when(empty, F.coalesce("m", F.array())).otherwise(F.col("t")).alias("items"))


def missing(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Rows of theirs whose key I don't have: to add, never to overwrite."""
    return theirs.join(mine.select(key).distinct(), key, "left_anti")


def face_decisions(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Faces of both copies: (photo, id, box, person, state, state_at), where photo is a file's fingerprint.

    A face of theirs is mine if it lies in the same photo and overlaps by half or more; the newer
    decision counts, a tie is mine. Faces that I lack are added, with ids below zero made from theirs.
    """
    pairs = matched_boxes(mine, theirs)
    other = theirs.select(F.col("id").alias("other_id"), F.col("person").alias("o_person"), F.col("state").alias("o_state"), F.col("state_at").alias("o_at"))
    joined = mine.join(pairs, "id", "left").join(other, "other_id", "left")
    newer = F.coalesce(F.col("o_at") > F.coalesce("state_at", F.lit(float("-inf"))), F.lit(False))
    pick = lambda c, o: F.when(newer, F.col(o)).otherwise(F.col(c)).alias(c)
    known = joined.select("photo", "id", "box", pick("person", "o_person"), pick("state", "o_state"), pick("state_at", "o_at"))
    fresh = theirs.join(pairs.select(F.col("other_id").alias("id")).distinct(), "id", "left_anti")
    return known.unionByName(fresh.select("photo", (-1 - F.col("id")).alias("id"), "box", "person", "state", "state_at"))


def one_per_name(people: DataFrame) -> DataFrame:
    """(id, keep): people of the same name, regardless of case and accents, as the one of the least id; nameless ones stay."""
    named = people.where(F.col("name").isNotNull()).select("id", fold("name").alias("n"))
    least = named.groupBy("n").agg(F.min("id").alias("keep"))
    return people.select("id").join(named.join(least, "n").select("id", "keep"), "id", "left").select("id", F.coalesce("keep", "id").alias("keep"))


def to_pull(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (name, size, mtime) of other copies whose size or time isn't what was seen last."""
    last = seen.select("name", F.col("size").alias("s"), F.col("mtime").alias("m"))
    return listing.join(last, "name", "left").where(F.col("s").isNull() | (F.col("s") != F.col("size")) | (F.col("m") != F.col("mtime"))).select("name", "size", "mtime")
