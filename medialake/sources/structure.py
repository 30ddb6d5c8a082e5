"""Side files of a library's arrangement, and the rebuilding of an index from them.

A document is a row (library, name, content), content being JSON. Folders and smart albums have one document
per library each, as have removed photos, watched folders and deleted albums; an album has one of its own.
Entries name each other by uuid, so that ids may be handed out anew. Many libraries are read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved
from .files import restored

VERSION = 1
ALBUM = "medialake-album"
STRUCTURE = "medialake"
FOLDERS, SMART, REMOVED, ROOTS, DELETED = "albums/_folders.json", "albums/_smart.json", "removed-photos.json", "watched-folders.json", "albums/_deleted.json"
FOLDER_ENTRY = "struct<uuid:string,name:string,parent_uuid:string,created_at:double,position:int,cover:string>"
SMART_ENTRY = "struct<uuid:string,name:string,match_mode:string,rules:string,folder_uuid:string,created_at:double>"
ROOT_ENTRY = "struct<path:string,in_library:boolean,enabled:boolean>"
SCHEMAS = {
    FOLDERS: f"format string, version int, folders array<{FOLDER_ENTRY}>, deleted map<string,double>",
    SMART: f"format string, version int, smart_albums array<{SMART_ENTRY}>, deleted map<string,double>",
    REMOVED: "format string, version int, photos map<string,double>",
    ROOTS: f"format string, version int, folders array<{ROOT_ENTRY}>",
    DELETED: "format string, version int, albums map<string,double>",
    ALBUM: "format string, version int, uuid string, name string, created_at double, changed_at double, folder_uuid string, cover string, photos array<string>, added map<string,double>",
}


def _document(name: Column | str, *fields: Column, kind: str = STRUCTURE) -> list[Column]:
    body = F.struct(F.lit(kind).alias("format"), F.lit(VERSION).alias("version"), *fields)
    return [(F.lit(name) if isinstance(name, str) else name).alias("name"), F.to_json(body).alias("content")]


def parsed(documents: DataFrame, name: str) -> DataFrame:
    """(library, name, doc) of the documents of a name, or of all albums (ALBUM); damaged and foreign ones are left out."""
    own = ~F.contains("name", F.lit("/_")) & F.startswith("name", F.lit("albums/")) if name == ALBUM else F.col("name") == name
    rows = documents.where(own).select("library", "name", F.from_json("content", SCHEMAS[name], {"mode": "PERMISSIVE"}).alias("doc"))
    return rows.where(F.col("doc.format") == (ALBUM if name == ALBUM else STRUCTURE))


def _listed(entries: DataFrame, entry: Column, key: str, name: str, before: DataFrame | None) -> DataFrame:
    """The document of a list: the entries, and those that only the earlier document knows and that weren't deleted."""
    place = F.coalesce(F.col("position").cast("long"), F.lit(0)) if "position" in entries.columns else F.lit(0).cast("long")
    rows = entries.select("library", F.lit(0).alias("side"), place.alias("place"), entry.alias("e"))
    gone = None
    if before is not None:
        old = parsed(before, name)
        gone = old.select("library", F.col("doc.deleted").alias("deleted"))
        known = old.select("library", F.col("doc.deleted").alias("deleted"), F.posexplode(F.col(f"doc.{key}")).alias("place", "e")).where("e.uuid is not null and not coalesce(map_contains_key(deleted, e.uuid), false)")
        extra = known.join(rows.select("library", F.col("e.uuid").alias("have")), (known["library"] == rows["library"]) & (F.col("e.uuid") == F.col("have")), "left_anti")
        rows = rows.union(extra.select("library", F.lit(1), F.col("place").cast("long"), "e"))
    lists = rows.groupBy("library").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "place", F.col("e.uuid").alias("uuid"), "e"))), lambda r: r["e"]).alias(key))
    if gone is not None:
        lists = lists.join(gone, "library", "full").withColumn(key, F.coalesce(key, F.array().cast(lists.schema[key].dataType)))
        return lists.select("library", *_document(name, F.col(key), F.col("deleted")))
    return lists.select("library", *_document(name, F.col(key)))


def folder_documents(folders: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """folders: library, id, uuid, name, parent_id, created_at, position, cover_path. before: the documents there are."""
    parent = folders.select("library", F.col("id").alias("parent_id"), F.col("uuid").alias("parent_uuid"))
    rows = folders.join(parent, ["library", "parent_id"], "left")
    entry = F.struct("uuid", "name", "parent_uuid", F.col("created_at").cast("double").alias("created_at"), F.col("position").cast("int").alias("position"), F.col("cover_path").alias("cover"))
    return _listed(rows, entry, "folders", FOLDERS, before)


def smart_documents(smart: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """smart: library, uuid, name, match_mode, rules (JSON), folder_uuid, created_at."""
    entry = F.struct("uuid", "name", "match_mode", "rules", "folder_uuid", F.col("created_at").cast("double").alias("created_at"))
    return _listed(smart, entry, "smart_albums", SMART, before)


def album_documents(albums: DataFrame, items: DataFrame) -> DataFrame:
    """albums: library, uuid, name, created_at, folder_uuid, cover; items: library, uuid, path, position, added_at."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(0)).alias("position"), "path", F.col("added_at").cast("double").alias("added_at"))))
    photos = items.where("path is not null").groupBy("library", "uuid").agg(order.alias("all"))
    rows = albums.join(photos, ["library", "uuid"], "left")
    safe = F.substring(F.regexp_replace(F.coalesce("name", F.lit("")), r"[^\p{L}\p{N} _-]", "_"), 1, 80)
    name = F.concat(F.lit("albums/"), F.when(safe == "", F.col("uuid")).otherwise(F.concat(safe, F.lit(" "), F.col("uuid"))), F.lit(".json"))
    some = F.coalesce("all", F.array().cast("array<struct<position:int,path:string,added_at:double>>"))
    added = F.map_from_entries(F.array_distinct(F.transform(F.filter(some, lambda r: r["added_at"].isNotNull()), lambda r: F.struct(r["path"], r["added_at"]))))
    return rows.select("library", *_document(name, F.col("uuid"), F.col("name"), F.col("created_at").cast("double").alias("created_at"), F.col("folder_uuid"), F.col("cover"), F.transform(some, lambda r: r["path"]).alias("photos"), added.alias("added"), kind=ALBUM))


def removed_documents(removed: DataFrame) -> DataFrame:
    """removed: library, path, removed_at (the latest counts)."""
    last = removed.where("path is not null").groupBy("library", "path").agg(F.max(F.col("removed_at").cast("double")).alias("at"))
    return last.groupBy("library").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "at")))).alias("photos")).select("library", *_document(REMOVED, F.col("photos")))


def tree(folders: DataFrame) -> DataFrame:
    """folders with ``under``: the parent that each gets when they are made again, in the order of ``place``.

    folders: library, uuid, parent_uuid, place, old (it is there already). A parent that isn't known is none.
    Of a cycle, one link is cut: the walk starts with the first folder that leads into it, goes up until it
    meets a folder again, and leaves that link out. Chains are doubled in rounds, each written to the shared
    folder; folders that are there already end them.
    """
    key = ["library", "uuid"]
    known = folders.select("library", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("known"))
    rows = saved(folders.join(known, ["library", "parent_uuid"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent_uuid"))).drop("known"))

    def doubled(jumps: DataFrame) -> DataFrame:
        """jumps (library, uuid, to) followed until nothing changes or as far as any chain goes."""
        n, length = rows.count(), 1
        while length < n:
            far = jumps.select("library", F.col("uuid").alias("to"), F.col("to").alias("far"))
            after = saved(jumps.join(far, ["library", "to"], "left").select("library", "uuid", F.col("far").alias("next"), "to"))
            moving = not after.where("next is not null").isEmpty() and not after.where("not (to <=> next)").isEmpty()
            jumps, length = after.select("library", "uuid", F.col("next").alias("to")), 2 * length
            if not moving:
                break
        return jumps

    up = rows.select("library", "uuid", F.when(F.col("old"), None).otherwise(F.col("parent")).alias("to"))
    cyclic = saved(doubled(up).where("to is not null").select("library", F.col("to").alias("uuid")).distinct())
    if cyclic.isEmpty():
        return rows.withColumn("under", F.col("parent")).drop("parent")
    loops = cyclic.withColumn("loop", F.lit(True))
    stop = up.join(loops, key, "left").select("library", "uuid", F.when(F.col("loop"), F.col("uuid")).otherwise(F.col("to")).alias("to"))
    entry = doubled(stop).where("to is not null").select("library", "uuid", F.col("to").alias("entry"))
    ring = cyclic.join(up, key)  # who is in one cycle: the least uuid of each, by doubling
    least = saved(ring.select("library", "uuid", "to", F.least("uuid", "to").alias("name")))
    while True:
        far = least.select("library", F.col("uuid").alias("to"), F.col("to").alias("far"), F.col("name").alias("other"))
        after = saved(least.join(far, ["library", "to"]).select("library", "uuid", F.col("far").alias("to"), F.least("name", "other").alias("name"), F.col("name").alias("was")))
        least = after.drop("was")
        if after.where("name <> was").isEmpty():
            break
    named = entry.join(least.select("library", F.col("uuid").alias("entry"), F.col("name").alias("cycle")), ["library", "entry"])
    first = named.join(rows.select("library", "uuid", "place"), key).groupBy("library", "cycle").agg(F.min_by("entry", F.struct("place", "uuid")).alias("parent"))
    cut = first.join(least.select("library", "uuid", F.col("name").alias("cycle")), ["library", "cycle"]).select("library", "uuid", "parent", F.lit(True).alias("cut"))
    return rows.join(cut, ["library", "uuid", "parent"], "left").withColumn("under", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut", "parent")


def restored_folders(documents: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(library, uuid, name, parent_uuid, created_at, position, cover_path) of folders that are made. have: library, uuid of those there are."""
    listed = parsed(documents, FOLDERS).select("library", F.posexplode("doc.folders").alias("place", "f")).where("f.uuid is not null")
    last = listed.groupBy("library", F.col("f.uuid").alias("uuid")).agg(F.max(F.struct("place", "f")).alias("b"))  # of one uuid the last counts
    rows = last.select("library", "uuid", "b.f.name", "b.f.parent_uuid", "b.f.created_at", "b.f.position", F.col("b.f.cover").alias("cover_path"), "b.place")
    old = rows.limit(0).select("library", "uuid") if have is None else have.select("library", "uuid").distinct()
    rows = rows.join(old.withColumn("old", F.lit(True)), ["library", "uuid"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    others = old.join(rows.select("library", "uuid"), ["library", "uuid"], "left_anti").withColumn("old", F.lit(True))
    made = tree(rows.unionByName(others, allowMissingColumns=True)).where("not old")
    name = F.when(F.coalesce("name", F.lit("")) == "", "Untitled Folder").otherwise(F.col("name"))
    return made.select("library", "uuid", name.alias("name"), F.col("under").alias("parent_uuid"), "created_at", "position", "cover_path")


def restored_albums(documents: DataFrame, folders: DataFrame, photos: DataFrame, have: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Albums (library, uuid, name, folder_uuid, cover) and their items (library, uuid, path, position).

    An album that is there (have), or was deleted after its last change, isn't made. A folder that isn't
    known is none; photos (library, path) that aren't there are left out, each counts once.
    """
    rows = parsed(documents, ALBUM).where("doc.uuid is not null").groupBy("library", "doc.uuid").agg(F.min("name").alias("name"), F.min_by("doc", "name").alias("doc"))
    deleted = parsed(documents, DELETED).select("library", F.explode("doc.albums").alias("uuid", "deleted_at"))
    latest = F.greatest(F.coalesce("doc.changed_at", F.lit(0.0)), F.coalesce(F.array_max(F.map_values("doc.added")), F.lit(0.0)))
    rows = rows.join(deleted, ["library", "uuid"], "left").where(F.col("deleted_at").isNull() | (F.col("deleted_at") < latest))
    if have is not None:
        rows = rows.join(have.select("library", "uuid"), ["library", "uuid"], "left_anti")
    rows = saved(rows)
    here = folders.select("library", F.col("uuid").alias("folder_uuid")).distinct()
    stem = F.regexp_replace(F.regexp_replace("name", "^albums/", ""), r"\.json$", "")
    name = F.when(F.coalesce("doc.name", F.lit("")) == "", stem).otherwise(F.col("doc.name"))
    there = photos.select("library", "path").distinct()
    filed = rows.select("library", "uuid", name.alias("name"), F.col("doc.folder_uuid").alias("f"), F.col("doc.cover").alias("path"))
    filed = filed.join(here.withColumn("f", F.col("folder_uuid")), ["library", "f"], "left").join(there.withColumn("cover", F.col("path")), ["library", "path"], "left")
    items = rows.select("library", "uuid", F.posexplode("doc.photos").alias("position", "path")).groupBy("library", "uuid", "path").agg(F.min("position").alias("position"))
    return filed.select("library", "uuid", "name", "folder_uuid", "cover"), items.join(there, ["library", "path"]).select("library", "uuid", "path", "position")


def restored_smart(documents: DataFrame, folders: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(library, uuid, name, match_mode, rules, folder_uuid) of smart albums that aren't there."""
    rows = parsed(documents, SMART).select("library", F.explode("doc.smart_albums").alias("s")).select("library", "s.*")
    if have is not None:
        rows = rows.join(have.select("library", "uuid"), ["library", "uuid"], "left_anti")
    here = folders.select("library", "uuid").distinct().select("library", F.col("uuid").alias("f"))
    rows = rows.withColumn("f", F.col("folder_uuid")).join(here.withColumn("known", F.lit(True)), ["library", "f"], "left")
    other = lambda c, default: F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.col(c)).alias(c)
    return rows.select("library", "uuid", other("name", "Smart Album"), other("match_mode", "all"), other("rules", "[]"), F.when(F.col("known"), F.col("folder_uuid")).alias("folder_uuid"))


def rebuilt(documents: DataFrame, listing: DataFrame, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """An index from nothing: removed, photos, folders, albums, items, smart.

    listing: library, path and what a scan knows. Photos that were removed stay out; then come albums,
    folders, smart albums, and albums go to their folders; last the marks (state, see files.restored).
    """
    removed = parsed(documents, REMOVED).select("library", F.explode("doc.photos").alias("path", "removed_at")).where("removed_at is not null")
    photos = listing.join(removed, ["library", "path"], "left_anti")
    folders = saved(restored_folders(documents))
    albums, items = restored_albums(documents, folders, photos)
    marked = photos if state is None else restored(photos, state)
    return {"removed": removed, "photos": marked, "folders": folders, "albums": albums, "items": items, "smart": restored_smart(documents, folders)}


def write_documents(documents: DataFrame, path: str) -> None:
    """The documents as JSON lines, by library; a new folder each time."""
    documents.write.mode("errorifexists").partitionBy("library").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, content string, library long").json(path)
