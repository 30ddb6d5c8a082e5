"""Pulling what other computers sent into a library: merged side files, then the index brought in line.

A document is a row (library, source, name, content), content being JSON as in sources.structure; the
source '' is the library's own copy. Any number of copies is merged at once, for many libraries at once:
of each entry the newest counts (a tie: the own one, then the source of least name), a deletion counts if it
isn't older than the newest entry, so the order in which copies arrive changes nothing. An album that one copy
deleted and another changed later comes back with the photos of all copies. Damaged and foreign documents
are left out; entries without a uuid or path too; missing times are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from ..sources import structure as st
from .rules import VIDEO_EXTENSIONS

MARKS = "photo-state.json"
MARK_FIELDS = "favorite int, rating int, hidden int, trashed_at double, title string, caption string, keywords string"
FOLDER_FIELDS = "name string, parent_uuid string, cover string"
SMART_FIELDS = "name string, match_mode string, rules string, folder_uuid string"
ORIGINALS, EDITS = "originals/", "edits/"
#: kind -> (document, field of its entries, field of what is gone, fields of an entry)
LISTS = {"folders": (st.FOLDERS, "folders", "deleted", FOLDER_FIELDS), "smart": (st.SMART, "smart_albums", "deleted", SMART_FIELDS), "marks": (MARKS, "photos", "cleared", MARK_FIELDS)}
ALBUM_SCHEMA = "format string, uuid string, name string, modified_at double, changed_at double, folder_uuid string, cover string, photos array<string>, added map<string,double>, removed map<string,double>"


# What is read


def changed(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of listing (library, source, name, size, mtime) that aren't as they were seen last (same columns)."""
    return listing.join(seen.select("library", "source", "name", "size", "mtime").distinct(), ["library", "source", "name", "size", "mtime"], "left_anti")


def seen_after(seen: DataFrame, listing: DataFrame, done: DataFrame) -> DataFrame:
    """What counts as seen once the files ``done`` (library, source, name) were dealt with; others stay as they were, to be read again."""
    key = ["library", "source", "name"]
    now = listing.join(done.select(*key).distinct(), key, "left_semi").select(*key, "size", "mtime")
    return seen.select(*key, "size", "mtime").join(now, key, "left_anti").unionByName(now)


def edits_to_take(listing: DataFrame, seen: DataFrame, local: DataFrame, sent: DataFrame) -> DataFrame:
    """(library, source, name, take) of edits that changed; take is false where an unsent local one isn't older.

    local, sent: library, name, size, mtime of the files here and of those this computer sent last. Both kinds
    count as seen: the kept ones at once, the taken ones once they are here.
    """
    new = changed(listing.where(F.startswith("name", F.lit(EDITS))), seen)
    here = local.select("library", "name", F.col("size").alias("l_size"), F.col("mtime").alias("l_at"))
    out = sent.select("library", "name", F.col("size").alias("s_size"), F.col("mtime").alias("s_at"))
    unsent = F.col("s_at").isNull() | (F.col("s_size") != F.col("l_size")) | (F.abs(F.col("s_at") - F.col("l_at")) >= 1)
    keep = F.col("l_at").isNotNull() & unsent & (F.col("l_at") >= F.col("mtime"))
    return new.join(here, ["library", "name"], "left").join(out, ["library", "name"], "left").select("library", "source", "name", (~F.coalesce(keep, F.lit(False))).alias("take"))


def originals_to_fetch(listing: DataFrame, local: DataFrame, removed: DataFrame, replacing: DataFrame) -> DataFrame:
    """(library, source, name, stage) of originals that aren't here, weren't removed on purpose and don't replace a local one.

    local, removed, replacing: library, name. Stage 0 are pictures, 1 videos, which take longer and come last.
    A file that several sources have is fetched from the one of least name.
    """
    here = local.select("library", "name").union(removed.select("library", "name")).union(replacing.select("library", "name")).distinct()
    new = listing.where(F.startswith("name", F.lit(ORIGINALS))).groupBy("library", "name").agg(F.min("source").alias("source")).join(here, ["library", "name"], "left_anti")
    video = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1)).isin(*VIDEO_EXTENSIONS)
    return new.select("library", "source", "name", video.cast("int").alias("stage"))


def adopted(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents with the paths of another computer's library as paths of this one; roots: library, source, root.

    Any text of a document that lies in the root of its source is moved to the root of source ''.
    """
    own = roots.where("source = ''").select("library", F.col("root").alias("own"))
    both = roots.where("source <> ''").join(own, "library").where("root <> own")
    inner = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("r"))), r'^\{"r":"(.*)"\}$', 1)
    escaped = F.regexp_replace(inner("root"), r"([^A-Za-z0-9/])", r"\\$1")
    way = both.select("library", "source", F.concat(F.lit(r'(?<!\\)"'), escaped, F.lit('(?=[/"])')).alias("__from"), F.concat(F.lit('"'), F.regexp_replace(inner("own"), r"([$\\])", r"\\$1")).alias("__to"))
    moved = F.when(F.col("__from").isNotNull(), F.regexp_replace("content", F.col("__from"), F.col("__to"))).otherwise(F.col("content"))
    return documents.join(way, ["library", "source"], "left").withColumn("content", moved).drop("__from", "__to")


# Merging


def _newest(*fields: str) -> list[Column]:
    """The fields of the entry that changed last, with its time, and the first place where its key is named."""
    order = F.struct((-F.col("at")).alias("at"), "source", "place")
    return [F.min_by(F.struct("at", *fields), order).alias("best"), F.min(F.struct("source", "place")).alias("first")]


def merged_list(documents: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Of folders, smart albums or marks: the entries (library, key, fields, modified_at, first) and what is gone (library, key, gone_at).

    The key is uuid, of marks path. ``first`` is the place in the merged list.
    """
    name, entries, gone, fields = LISTS[kind]
    key = "path" if kind == "marks" else "uuid"
    columns = [f.split()[0] for f in fields.split(", ")]
    entry = ", ".join(f.replace(" ", ":", 1) for f in [*(["uuid string"] if key == "uuid" else []), *fields.split(", "), "modified_at double"])
    shape = f"map<string,struct<{entry}>>" if key == "path" else f"array<struct<{entry}>>"
    doc = documents.where(F.col("name") == name).select("library", "source", F.from_json("content", f"format string, {entries} {shape}, {gone} map<string,double>").alias("doc")).where(F.col("doc.format") == st.STRUCTURE)
    if key == "path":
        rows = doc.select("library", "source", F.posexplode(f"doc.{entries}").alias("place", key, "e"))
    else:
        rows = doc.select("library", "source", F.posexplode(f"doc.{entries}").alias("place", "e")).withColumn(key, F.col("e.uuid"))
    rows = rows.where(F.col(key).isNotNull() & F.col("e").isNotNull()).select("library", "source", "place", key, *(F.col(f"e.{c}").alias(c) for c in columns), F.coalesce("e.modified_at", F.lit(0.0)).alias("at"))
    out = doc.select("library", F.explode(f"doc.{gone}").alias(key, "gone_at")).groupBy("library", key).agg(F.max(F.coalesce("gone_at", F.lit(0.0))).alias("gone_at"))
    best = rows.groupBy("library", key).agg(*_newest(*columns)).join(out, ["library", key], "full")
    stays = F.col("best").isNotNull() & (F.col("gone_at").isNull() | (F.col("gone_at") < F.col("best.at")))
    kept = best.where(stays).select("library", key, *(F.col(f"best.{c}").alias(c) for c in columns), F.col("best.at").alias("modified_at"), "first")
    return kept, best.where(~stays).select("library", key, "gone_at")


def _times(documents: DataFrame, name: str, field: str, key: str) -> DataFrame:
    doc = documents.where(F.col("name") == name).select("library", F.from_json("content", f"format string, {field} map<string,double>").alias("doc")).where(F.col("doc.format") == st.STRUCTURE)
    return doc.select("library", F.explode(f"doc.{field}").alias(key, "gone_at")).where("gone_at is not null").groupBy("library", key).agg(F.max("gone_at").alias("gone_at"))


def merged_removed(documents: DataFrame) -> DataFrame:
    """(library, path, gone_at): a photo removed on any computer stays removed."""
    return _times(documents, st.REMOVED, "photos", "path")


def merged_albums(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Albums (library, uuid, name, folder_uuid, cover, modified_at), their photos and what is gone.

    Photos: library, uuid, path, added, removed, first, stays. A photo stays if its last addition isn't before its
    last removal. An album is gone if its deletion isn't older than its last change and its photos' last addition.
    """
    own = ~F.contains("name", F.lit("/_")) & F.startswith("name", F.lit("albums/"))
    doc = documents.where(own).select("library", "source", "name", F.from_json("content", ALBUM_SCHEMA).alias("doc")).where((F.col("doc.format") == st.ALBUM) & F.col("doc.uuid").isNotNull())
    rows = doc.select("library", "source", F.col("name").alias("place"), "doc.uuid", "doc.name", "doc.folder_uuid", "doc.cover", F.coalesce("doc.modified_at", "doc.changed_at", F.lit(0.0)).alias("at"))
    best = rows.groupBy("library", "uuid").agg(*_newest("name", "folder_uuid", "cover"))
    stamp = F.coalesce(F.try_element_at("doc.added", F.col("path")), F.lit(0.0))
    named = doc.select("library", "source", "doc", F.posexplode("doc.photos").alias("place", "path")).where("path is not null")
    put = named.select("library", "doc.uuid", "path", stamp.alias("added"), F.lit(None).cast("double").alias("removed"), F.struct("source", "place").alias("first"))
    taken = doc.select("library", "doc.uuid", F.explode("doc.removed").alias("path", "removed"))
    taken = taken.select("library", "uuid", "path", F.lit(None).cast("double").alias("added"), F.coalesce("removed", F.lit(0.0)).alias("removed"), F.lit(None).cast(put.schema["first"].dataType).alias("first"))
    items = put.union(taken).groupBy("library", "uuid", "path").agg(F.max("added").alias("added"), F.max("removed").alias("removed"), F.min("first").alias("first"))
    items = saved(items.withColumn("stays", F.coalesce(F.col("added") >= F.coalesce("removed", F.lit(-1.0)), F.lit(False))))
    last = items.where("stays").groupBy("library", "uuid").agg(F.max("added").alias("last"))
    both = best.join(last, ["library", "uuid"], "left").join(_times(documents, st.DELETED, "albums", "uuid"), ["library", "uuid"], "full")
    stays = F.col("best").isNotNull() & (F.col("gone_at").isNull() | (F.col("gone_at") < F.greatest("best.at", F.coalesce("last", F.lit(0.0)))))
    kept = both.where(stays).select("library", "uuid", "best.name", "best.folder_uuid", "best.cover", F.col("best.at").alias("modified_at"))
    return kept, items.join(kept.select("library", "uuid"), ["library", "uuid"], "left_semi"), both.where(~stays).select("library", "uuid", "gone_at")


# The index in line


def _beneath(folders: DataFrame, gone: DataFrame) -> DataFrame:
    """(library, uuid) of the folders ``gone`` and all inside them, by doubling the way up; folders: library, uuid, parent_uuid, no cycles."""
    flag = gone.select("library", "uuid").distinct().withColumn("dead", F.lit(True))
    rows = saved(folders.select("library", "uuid", F.col("parent_uuid").alias("up")).join(flag, ["library", "uuid"], "left").withColumn("dead", F.coalesce("dead", F.lit(False))))
    while not rows.where("up is not null and not dead").isEmpty():
        above = rows.select("library", F.col("uuid").alias("up"), F.col("up").alias("far"), F.col("dead").alias("above"))
        rows = saved(rows.join(above, ["library", "up"], "left").select("library", "uuid", F.col("far").alias("up"), (F.col("dead") | F.coalesce("above", F.lit(False))).alias("dead")))
    return rows.where("dead").select("library", "uuid")


def _given(new: str, old: str) -> Column:
    return F.coalesce(F.when(F.col(new) != "", F.col(new)), F.col(old))


def _side(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select("library", "uuid", F.lit(True).alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def arranged_folders(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folders (library, uuid, name, parent_uuid, cover) as they are and as wanted; a parent nobody knows is none.

    All moves are made at once. Where two computers moved folders into each other, the link is cut that closes
    the cycle on the way up from its first folder in the merged list; that folder comes to the top.
    """
    both = _side(index, "h", "name", "parent_uuid", "cover").join(_side(wanted, "w", "name", "parent_uuid", "cover", "first"), ["library", "uuid"], "full")
    rows = both.select("library", "uuid", F.coalesce(_given("w_name", "h_name"), F.lit("Untitled Folder")).alias("name"), F.when(F.col("w"), F.col("w_parent_uuid")).otherwise(F.col("h_parent_uuid")).alias("parent_uuid"), _given("w_cover", "h_cover").alias("cover"), F.col("w_first").alias("place"), F.lit(False).alias("old"))
    return st.tree(rows).select("library", "uuid", "name", F.col("under").alias("parent_uuid"), "cover")


def _filed(index: DataFrame, wanted: DataFrame, folders: DataFrame, name: str, *more: str) -> DataFrame:
    """Albums or smart albums as they are and as wanted, in the folder wanted if it is there, else in none."""
    both = _side(index, "h", "name", "folder_uuid", *more).join(_side(wanted, "w", "name", "folder_uuid", *more), ["library", "uuid"], "full")
    there = folders.select("library", F.col("uuid").alias("w_folder_uuid"), F.lit(True).alias("there")).distinct()
    rows = both.join(there, ["library", "w_folder_uuid"], "left")
    folder = F.when(F.col("w"), F.when(F.col("there"), F.col("w_folder_uuid"))).otherwise(F.col("h_folder_uuid"))
    return rows.select("library", "uuid", F.coalesce(_given("w_name", "h_name"), F.lit(name)).alias("name"), folder.alias("folder_uuid"), *(c for m in more for c in (F.col(f"w_{m}").alias(f"w_{m}"), F.col(f"h_{m}").alias(f"h_{m}"))), F.coalesce("w", F.lit(False)).alias("w"))


def photos_left(index: dict[str, DataFrame], documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos without those that were removed on any computer, and the removed ones that are known then."""
    known = index["removed"].select("library", "path", "gone_at")
    fresh = merged_removed(documents).join(known.select("library", "path"), ["library", "path"], "left_anti")  # a photo put back here on purpose stays
    return index["photos"].join(fresh.select("library", "path"), ["library", "path"], "left_anti"), known.unionByName(fresh.select("library", "path", "gone_at"))


def folders_left(index: dict[str, DataFrame], documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All folders as arranged, and those (library, folder_uuid) that are deleted once the albums have moved."""
    wanted, gone = merged_list(documents, "folders")
    folders = saved(arranged_folders(index["folders"], wanted))
    return folders, saved(_beneath(folders, gone).select("library", F.col("uuid").alias("folder_uuid")))


def smart_left(index: dict[str, DataFrame], documents: DataFrame, folders: DataFrame) -> DataFrame:
    wanted, gone = merged_list(documents, "smart")
    rows = _filed(index["smart"], wanted, folders, "Smart Album", "match_mode", "rules").join(gone.select("library", "uuid"), ["library", "uuid"], "left_anti")
    now = lambda c, default: F.coalesce(F.when(F.col("w"), F.when(F.col(f"w_{c}") != "", F.col(f"w_{c}"))).otherwise(F.col(f"h_{c}")), F.lit(default)).alias(c)
    return rows.select("library", "uuid", "name", now("match_mode", "all"), now("rules", "[]"), "folder_uuid")


def albums_left(index: dict[str, DataFrame], documents: DataFrame, photos: DataFrame, folders: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and items; photos added are those that are there, a cover that isn't there changes nothing."""
    wanted, members, gone = merged_albums(documents)
    there = photos.select("library", "path").distinct()
    rows = _filed(index["albums"], wanted, folders, "Album", "cover").join(gone.select("library", "uuid"), ["library", "uuid"], "left_anti").join(dead, ["library", "folder_uuid"], "left_anti")
    shown = there.select("library", F.col("path").alias("w_cover"), F.lit(True).alias("shown"))
    albums = saved(rows.join(shown, ["library", "w_cover"], "left").select("library", "uuid", "name", "folder_uuid", F.when(F.col("shown"), F.col("w_cover")).otherwise(F.col("h_cover")).alias("cover")))
    key = ["library", "uuid", "path"]
    told = members.select(*key, "stays")
    items = index["items"].select(*key).distinct().join(told, key, "full").where(F.coalesce("stays", F.lit(True))).select(*key)
    return albums, items.join(there, ["library", "path"], "left_semi").join(albums.select("library", "uuid"), ["library", "uuid"], "left_semi").select(*key)


def marked(photos: DataFrame, documents: DataFrame) -> DataFrame:
    """Photos with the marks that are told of, plain where marks were cleared; others keep theirs."""
    marks, cleared = merged_list(documents, "marks")
    fields = [f.split()[0] for f in MARK_FIELDS.split(", ")]
    plain = {"favorite": F.lit(0), "rating": F.lit(0), "hidden": F.lit(0)}
    told = {c: F.col(f"m.{c}") for c in fields} | {"rating": F.coalesce("m.rating", F.lit(0))}
    told |= {c: (F.coalesce(f"m.{c}", F.lit(0)) != 0).cast("int") for c in ("favorite", "hidden")}
    news = marks.select("library", "path", F.struct(*fields).alias("m"), F.lit(False).alias("clear")).unionByName(cleared.select("library", "path", F.lit(True).alias("clear")), allowMissingColumns=True)
    rows = photos.join(news.select("library", "path", F.struct("m", "clear").alias("__told")), ["library", "path"], "left").withColumn("m", F.col("__told.m"))
    now = {c: F.when(F.col("__told.clear"), plain.get(c, F.lit(None))).when(F.col("m").isNotNull(), told[c]).otherwise(F.col(c)) for c in fields}
    return rows.withColumns(now).select(*photos.columns)


def applied(index: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """The index brought in line with the merged documents of all copies.

    index, and the result, each by library: photos (path and the marks, more columns stay), folders (uuid, name, parent_uuid, cover),
    smart (uuid, name, match_mode, rules, folder_uuid), albums (uuid, name, folder_uuid, cover), items (uuid, path) and
    removed (path, gone_at). In this order: removed photos leave the photos and the albums; folders are made, renamed and
    moved; smart albums and albums are made, renamed and moved, with photos added and taken out; deleted albums go;
    deleted folders go with all that is still inside them; marks are set or cleared.
    """
    photos, removed = photos_left(index, documents)
    folders, dead = folders_left(index, documents)
    smart = smart_left(index, documents, folders).join(dead, ["library", "folder_uuid"], "left_anti")
    albums, items = albums_left(index, documents, photos, folders, dead)
    folders = folders.join(dead.withColumnRenamed("folder_uuid", "uuid"), ["library", "uuid"], "left_anti")
    return {"photos": marked(photos, documents), "folders": folders, "smart": smart, "albums": albums, "items": items, "removed": removed}


def pulled(index: dict[str, DataFrame], documents: DataFrame, listing: DataFrame, seen: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The index after a pull, and what counts as seen then; of other sources only documents that changed are merged."""
    key = ["library", "source", "name"]
    new = changed(listing, seen).select(*key)
    read = documents.where("source = ''").unionByName(documents.where("source <> ''").join(new, key, "left_semi").select(*documents.columns))
    done = read.where("source <> ''").select(*key)
    return applied(index, read.select("library", "source", "name", "content")), seen_after(seen, listing, done)
