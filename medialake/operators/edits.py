"""What people change: marks, details, folders, albums, people and events, as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_one, merge_keywords
from .summary import may_move


def edited(user: DataFrame, paths: DataFrame, at: float, **values: object) -> DataFrame:
    """The user table with columns set for the given paths (path); ratings are held to 0..5; unknown paths get a row.

    values: column -> value or Column.
    """
    hit = paths.select("path").distinct().withColumn("__hit", F.lit(True))
    joined = user.join(hit, "path", "full")

    def value(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    sets = {c: F.greatest(F.lit(0), F.least(F.lit(5), value(v))) if c == "rating" else value(v) for c, v in values.items()} | {"modified_at": F.lit(at)}
    types = dict(user.dtypes)
    return joined.select("path", *(F.when(F.col("__hit"), sets[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in sets else F.col(c) for c in user.columns if c != "path"))


def with_keywords(user: DataFrame, paths: DataFrame, at: float, more: str) -> DataFrame:
    """Keywords added to those that are there."""
    return edited(user, paths, at, keywords=merge_keywords(F.col("keywords"), F.lit(more)))


def shifted(photos: DataFrame, ids: DataFrame, seconds: float) -> DataFrame:
    """Dates moved by some seconds and kept from then on (source 'manual')."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = photos.join(hit, "id", "left")
    new = {"taken_at": F.when(F.col("__hit"), F.col("taken_at") + seconds).otherwise(F.col("taken_at")), "date_source": F.when(F.col("__hit") & F.col("taken_at").isNotNull(), "manual").otherwise(F.col("date_source"))}
    return joined.withColumns(new).select(*photos.columns)


def trashed(user: DataFrame, paths: DataFrame, at: float) -> DataFrame:
    return edited(user, paths, at, trashed_at=at)


def forgotten(photos: DataFrame, removed: DataFrame, paths: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """Photos without the given paths, and the removed list with them, so that no scan brings them back."""
    gone = paths.select("path").distinct()
    both = removed.select("path", "removed_at").unionByName(gone.withColumn("removed_at", F.lit(at)))
    return photos.join(gone, "path", "left_anti"), both.groupBy("path").agg(F.max("removed_at").alias("removed_at"))


# Folders and albums: (id, uuid, name, parent_id or folder_id, position)


def created(table: DataFrame, parent: str, new_id: int, uuid: str, name: str, under: int | None) -> DataFrame:
    """A new entry after the last one under the same parent."""
    same = F.col(parent).eqNullSafe(F.lit(under))
    last = table.where(same).agg(F.max("position")).first()[0]
    row = {"id": new_id, "uuid": uuid, "name": name, parent: under, "position": 0 if last is None else last + 1}
    one = table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)
    return table.unionByName(one)


def renamed(table: DataFrame, entry: int, name: str) -> DataFrame:
    """Blank names change nothing."""
    return table.withColumn("name", F.when((F.col("id") == entry) & F.lit(bool(name.strip())), F.lit(name.strip())).otherwise(F.col("name")))


def moved(folders: DataFrame, folder: int, target: int | None) -> DataFrame:
    """A folder under another one; into itself or what it holds is an error."""
    if target is not None and (folder == target or not may_move(folders, folder, target)):
        raise ValueError("a folder can't go into itself")
    return folders.withColumn("parent_id", F.when(F.col("id") == folder, F.lit(target)).otherwise(F.col("parent_id")))


def deleted(folders: DataFrame, albums: DataFrame, items: DataFrame, folder: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders, albums and album items without a folder and all it holds; photos stay."""
    from .summary import closure

    inside = closure(folders).where(F.col("ancestor") == folder).select("id")
    left = albums.join(inside.withColumnRenamed("id", "folder_id"), "folder_id", "left_anti")
    return folders.join(inside, "id", "left_anti"), left, items.join(left.select(F.col("id").alias("album_id")), "album_id", "left_semi")


def with_items(items: DataFrame, album: int, photos: DataFrame) -> DataFrame:
    """Album items with more photos (id), each once, after the last position, in the order of ids (positions may have gaps)."""
    last = items.where(F.col("album_id") == album).agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0]
    fresh = photos.select(F.col("id").alias("photo_id")).distinct().join(items.where(F.col("album_id") == album).select("photo_id"), "photo_id", "left_anti")
    return items.unionByName(fresh.select(F.lit(album).cast("long").alias("album_id"), "photo_id", (F.lit(last + 1) + F.col("photo_id")).cast("long").alias("position")))


# People: (id, name), faces (id, person_id, state), apart (a, b)


def person_named(people: DataFrame, faces: DataFrame, apart: DataFrame, person: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A person's name; if another person has it (regardless of case and accents), the two become one."""
    other = people.where((F.col("id") != person) & (fold("name") == fold_one(name))).agg(F.min("id")).first()[0]
    if other is None:
        return people.withColumn("name", F.when(F.col("id") == person, F.lit(name)).otherwise(F.col("name"))), faces, apart
    return people_merged(people, faces, apart, person, other)


def people_merged(people: DataFrame, faces: DataFrame, apart: DataFrame, old: int, new: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One person goes up in another: faces and 'apart' marks follow; a mark between the two goes."""
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    marks = apart.select(swap("a").alias("x"), swap("b").alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return people.where(F.col("id") != old), faces.withColumn("person_id", swap("person_id")), marks


def faces_assigned(faces: DataFrame, ids: DataFrame, person: int | None, state: int) -> DataFrame:
    """Faces given to a person, or taken from one (None), with the state of a decision: 1 confirmed, 2 removed, 3 ignored."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = faces.join(hit, "id", "left")
    new = {"person_id": F.when(F.col("__hit"), F.lit(person)).otherwise(F.col("person_id")), "state": F.when(F.col("__hit"), F.lit(state)).otherwise(F.col("state"))}
    return joined.withColumns(new).select(*faces.columns)


def without_empty_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People but those that have neither a name nor a face."""
    seen = faces.where("person_id is not null").select(F.col("person_id").alias("id")).distinct().withColumn("__seen", F.lit(True))
    return people.join(seen, "id", "left").where(F.col("name").isNotNull() | F.col("__seen")).select(*people.columns)


def event_as_album(event_members: DataFrame, album: int) -> DataFrame:
    """(album_id, photo_id, position) of an event's photos (id, taken_at), by time."""
    return event_members.select(F.lit(album).cast("long").alias("album_id"), F.col("id").alias("photo_id"), F.floor("taken_at").cast("long").alias("position"))


def check_record(known: DataFrame, seen: DataFrame, at: float) -> DataFrame:
    """The check table after new states (key, state): the time, and the first time a damage was seen."""
    joined = known.join(seen.select("key", F.col("state").alias("__s")), "key", "full")
    damaged = F.when(F.coalesce("__s", "state") == "damaged", F.coalesce("damaged_at", F.lit(at))).otherwise(F.col("damaged_at"))
    return joined.select("key", F.coalesce("__s", "state").alias("state"), F.when(F.col("__s").isNotNull(), F.lit(at)).otherwise(F.col("checked_at")).alias("checked_at"), damaged.alias("damaged_at"))


def repointed(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Every table with a path column, after the renames (path, new_path)."""
    m = mapping.select("path", "new_path").dropDuplicates(["path"])
    return {n: t.join(m, "path", "left").withColumn("path", F.coalesce("new_path", "path")).select(*t.columns) for n, t in tables.items()}
