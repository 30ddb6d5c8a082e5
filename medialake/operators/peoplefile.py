"""What computers tell each other about people: tables of people, merges, faces and answers, merged into one library's.

A face of another computer is known by the fingerprint of its photo and by its box, a person by a uuid. Every table
has a library and a source, the computer that wrote it; any number of sources is merged at once, and their order
changes nothing: the newest counts (a tie: this computer, then the source of least name).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import from_half, to_half
from ..shared import saved
from ..sources.structure import tree
from .people import overlap, unit

AUTO, CONFIRMED, REMOVED, IGNORED = 0, 1, 2, 3
SAME_BOX = 0.5
COVER_NEAR = 0.02
#: The tables of a people file, beside library and source.
TABLES = {
    "people": "uuid string, name string, name_at double, cover_at double, cover_fp string, cover_x double, cover_y double",
    "merged": "old string, new string, at double",
    "apart": "a string, b string",
    "answers": "link double, same int, at double",
    "clean": "fp string, version int",
    "faces": "fp string, x double, y double, w double, h double, score double, px long, yaw double, roll double, emb string, person string, state int, state_at double, was string, pinned int, version int",
}
#: The columns of a face here, beside library, id and photo_id.
FACE = ("x", "y", "w", "h", "score", "px", "yaw", "roll", "emb", "person", "state", "state_at", "was", "pinned")


def exported(index: dict[str, DataFrame], source: str, version: int) -> dict[str, DataFrame]:
    """The tables that this computer sends.

    index: people (uuid, name, name_at, cover_face, cover_at), faces (id, photo_id and FACE; person and was are uuids), photos
    (id, fingerprint; no videos), scans (photo_id, version), merged, apart, answers; all with a library. Of photos of one
    content the one of least id speaks. Vectors go as half floats in base64. Clean are contents looked at that have no face.
    """
    photos = index["photos"].where("fingerprint is not null").select("library", F.col("id").alias("photo_id"), F.col("fingerprint").alias("fp"))
    speaks = photos.groupBy("library", "fp").agg(F.min("photo_id").alias("photo_id"))
    places = {"x": 4, "y": 4, "w": 4, "h": 4, "score": 3, "yaw": 3, "roll": 1, "state_at": 3}
    now = {c: F.round(c, n) for c, n in places.items()} | {"emb": F.base64(to_half("emb"))}
    faces = index["faces"].join(speaks, ["library", "photo_id"]).withColumn("version", F.lit(version)).select("library", "fp", *(now.get(c, F.col(c)).alias(c) for c in FACE), "version")
    seen = index["scans"].where(F.col("version") >= version).join(photos, ["library", "photo_id"]).select("library", "fp").distinct()
    clean = seen.join(index["faces"].join(photos, ["library", "photo_id"]).select("library", "fp").distinct(), ["library", "fp"], "left_anti").withColumn("version", F.lit(version))
    cover = index["faces"].select("library", F.col("id").alias("cover_face"), "photo_id", F.col("x").alias("cover_x"), F.col("y").alias("cover_y")).join(photos.withColumnRenamed("fp", "cover_fp"), ["library", "photo_id"])
    people = index["people"].where("uuid is not null").withColumn("cover_face", F.when(F.col("cover_at") > 0, F.col("cover_face"))).join(cover, ["library", "cover_face"], "left").withColumns({"name_at": F.round("name_at", 3), "cover_at": F.round("cover_at", 3)})
    out = {"people": people, "clean": clean, "faces": faces} | {t: index[t] for t in ("merged", "apart", "answers")}
    return {t: df.withColumn("source", F.lit(source)).select("library", "source", *(c.split()[0] for c in TABLES[t].split(", "))) for t, df in out.items()}


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(library, source, rows, digest) of what is sent, whatever its order: two 32-bit halves of the rows' hashes are summed."""
    hashes = [df.select("library", "source", F.xxhash64(F.lit(t), *(c for c in df.columns if c not in ("library", "source"))).alias("h")) for t, df in tables.items()]
    all_ = functools.reduce(DataFrame.union, hashes)
    return all_.groupBy("library", "source").agg(F.count("*").alias("rows"), F.concat_ws("-", F.sum(F.expr("h & 4294967295")), F.sum(F.shiftrightunsigned("h", 32))).alias("digest"))


def to_write(tables: dict[str, DataFrame], last: DataFrame) -> dict[str, DataFrame]:
    """The tables of the libraries whose digest isn't that of the last time (digests)."""
    new = saved(digests(tables).join(last.select("library", "source", "rows", "digest"), ["library", "source", "rows", "digest"], "left_anti").select("library", "source"))
    return {t: df.join(new, ["library", "source"], "left_semi") for t, df in tables.items()}


def write_people(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines, a folder per table; a new path each time."""
    for t, df in tables.items():
        df.write.mode("errorifexists").json(f"{path.rstrip('/')}/{t}")


def read_people(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """The tables of any number of people files; lines that aren't JSON are left out."""
    read = {t: spark.read.schema(f"library long, source string, {c}").option("mode", "DROPMALFORMED").json([f"{p.rstrip('/')}/{t}" for p in paths]) for t, c in TABLES.items()}
    return {t: df.where("library is not null and source is not null") for t, df in read.items()}


def redirects(links: DataFrame) -> DataFrame:
    """(library, uuid, to): whom a person became in the end, from (library, old, new, at).

    Of several links of a person the newest counts (a tie: the least); of a cycle the link is cut that leads
    back on the way from its oldest. Chains are doubled in rounds.
    """
    best = links.where("old is not null and new is not null and old <> new").groupBy("library", F.col("old").alias("uuid")).agg(F.min(F.struct((-F.coalesce("at", F.lit(0.0))).alias("neg"), F.col("new").alias("parent_uuid"))).alias("b"))
    olds = best.select("library", "uuid", "b.parent_uuid", (-F.col("b.neg")).alias("place"))
    ends = olds.select("library", F.col("parent_uuid").alias("uuid")).distinct().join(olds.select("library", "uuid"), ["library", "uuid"], "left_anti")
    rows = tree(olds.unionByName(ends, allowMissingColumns=True).withColumn("old", F.lit(False))).where("under is not null").select("library", "uuid", F.col("under").alias("to"))
    rows = saved(rows)
    while True:
        far = rows.select("library", F.col("uuid").alias("to"), F.col("to").alias("far"))
        after = saved(rows.join(far, ["library", "to"], "left").select("library", "uuid", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
        rows = after.drop("moved")
        if after.where("moved").isEmpty():
            return rows


def _follow(df: DataFrame, to: DataFrame, *columns: str) -> DataFrame:
    """df with the people in these columns as whom they became."""
    for c in columns:
        df = df.join(to.select("library", F.col("uuid").alias(c), F.col("to").alias("__to")), ["library", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return df


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def merged_people(mine: DataFrame, theirs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People (library, uuid, name, name_at) after all names and merges, and whom each uuid became (library, uuid, to).

    A name from elsewhere counts if it is newer. Who was merged is gone; the one they became keeps the name, or takes
    the newest of theirs. People of the same name, regardless of case and spaces, are one: one of this computer if
    there is any, of least uuid. An unnamed person of another computer comes with faces only.
    """
    key = ["library", "uuid"]
    cols = ["library", "uuid", "name", F.coalesce("name_at", F.lit(0.0)).alias("name_at"), "source"]
    rows = mine.withColumn("source", F.lit("")).select(*cols).union(theirs.where(~_blank("name")).select(*cols)).where("uuid is not null")
    best = rows.groupBy(*key).agg(F.min_by(F.struct("name", "name_at"), F.struct((-F.col("name_at")).alias("neg"), "source")).alias("b"), F.min("source").alias("source"))
    to = redirects(links)
    joined = best.join(to, key, "left")
    whole = joined.groupBy("library", F.coalesce("to", "uuid").alias("uuid")).agg(
        F.max(F.when(F.col("to").isNull() & ~_blank("b.name"), F.col("b"))).alias("own"), F.max_by("b", F.struct(F.col("b.name_at"), F.col("b.name"))).alias("old"),
        F.max_by("b", F.when(~_blank("b.name"), F.struct(F.col("b.name_at").alias("t"), F.col("b.name").alias("n")))).alias("named"), F.min("source").alias("source"))
    people = saved(whole.select("library", "uuid", F.coalesce("own.name", "named.name").alias("name"), F.coalesce("own.name_at", "named.name_at", "old.name_at").alias("name_at"), "source"))
    plain = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    named = people.where(~_blank("name")).select("library", "uuid", plain.alias("n"), (F.col("source") != "").alias("far"))
    keep = named.groupBy("library", "n").agg(F.min(F.struct("far", F.col("uuid").alias("keep"))).alias("k"))
    same = saved(named.join(keep, ["library", "n"]).select("library", "uuid", F.col("k.keep").alias("to")).where("uuid <> to"))
    left = people.join(same.select(*key), key, "left_anti").select("library", "uuid", "name", "name_at")
    return left, _follow(to, same, "to").select("library", "uuid", "to").unionByName(same.join(to.select(*key), key, "left_anti"))


def merged_faces(mine: DataFrame, theirs: DataFrame, photos: DataFrame, scans: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces (library, id, photo_id, FACE) after all decisions, and scans (library, photo_id, version).

    A photo not looked at here and without faces takes them whole, from the source that looked in the newest way
    (a tie: of least name); vectors come back from half floats as unit vectors, zero ones are left out, ids are
    below zero and made from photo and box. In other photos a decision (confirmed, removed, ignored) counts for the
    face here that overlaps its box most, by half or more, if it is newer than what was decided here. Who was taken
    out stays as ``was``.
    """
    here = photos.where("fingerprint is not null").select("library", F.col("id").alias("photo_id"), F.col("fingerprint").alias("fp"))
    done = scans.select("library", "photo_id").union(mine.select("library", "photo_id")).distinct()
    new = here.join(done, ["library", "photo_id"], "left_anti")
    chosen = theirs.groupBy("library", "fp").agg(F.min(F.struct((-F.coalesce("version", F.lit(1))).alias("neg"), "source")).alias("c")).select("library", "fp", F.col("c.source").alias("source"), (-F.col("c.neg")).alias("looked"))
    open_ = saved(new.join(chosen, ["library", "fp"]))
    came = theirs.join(open_, ["library", "fp", "source"]).withColumn("emb", from_half(F.unbase64("emb")))
    came = came.where(F.exists("emb", lambda v: v != 0)).withColumn("emb", unit("emb").cast("array<float>")).withColumn("id", -1 - F.expr("xxhash64(library, photo_id, x, y, w, h) & 4611686018427387903"))
    came = came.dropDuplicates(["library", "id"])
    faces = saved(_follow(mine.select("library", "id", "photo_id", *FACE).unionByName(came.select("library", "id", "photo_id", *FACE)), to, "person", "was"))
    told = theirs.where(F.col("state").isin(CONFIRMED, REMOVED, IGNORED) & (F.col("w") > 0) & (F.col("h") > 0)).withColumn("state_at", F.coalesce("state_at", F.lit(0.0)))
    told = _follow(told.select("library", "source", "fp", F.struct("x", "y", "w", "h").alias("b"), "person", "was", "state", "state_at"), to, "person", "was").withColumn("face", F.struct("source", "b", "state_at", "state", "person", "was"))
    boxes = faces.join(here, ["library", "photo_id"]).select("library", "fp", "photo_id", "id", F.struct("x", "y", "w", "h").alias("a"))
    pairs = boxes.join(told.select("library", "fp", "b", "face"), ["library", "fp"]).withColumn("iou", overlap("a", "b")).where(F.col("iou") >= SAME_BOX)
    nearest = pairs.groupBy("library", "photo_id", "face").agg(F.max_by("id", F.struct("iou", (-F.col("id")).alias("neg"))).alias("id"))
    news = nearest.groupBy("library", "id").agg(F.min_by("face", F.struct((-F.col("face.state_at")).alias("neg"), F.col("face.source"), F.col("face.state"), F.col("face.b"))).alias("d"))
    rows = faces.join(news, ["library", "id"], "left")
    newer = F.coalesce(F.col("d.state_at") > F.coalesce("state_at", F.lit(0.0)), F.lit(False))
    confirmed = newer & (F.col("d.state") == CONFIRMED)
    decided = {
        "was": F.when(newer & ~confirmed, F.coalesce("person", "d.was")).otherwise(F.col("was")), "person": F.when(confirmed, F.col("d.person")).when(~newer, F.col("person")),
        "state": F.when(newer, F.col("d.state")).otherwise(F.col("state")), "state_at": F.when(newer, F.col("d.state_at")).otherwise(F.col("state_at")),
    }
    looked = scans.select("library", "photo_id", "version").unionByName(open_.select("library", "photo_id", F.col("looked").alias("version")))
    return rows.withColumns(decided).select("library", "id", "photo_id", *FACE), looked


def looked_at(scans: DataFrame, faces: DataFrame, photos: DataFrame, clean: DataFrame, version: int) -> DataFrame:
    """Scans, and those of photos without faces that another computer looked at in this way and found empty."""
    told = clean.where(F.col("version") >= version).select("library", F.col("fp").alias("fingerprint")).distinct()
    key = ["library", "photo_id"]
    empty = photos.join(told, ["library", "fingerprint"]).select("library", F.col("id").alias("photo_id")).join(faces.select(*key), key, "left_anti").withColumn("version", F.lit(version))
    return scans.select(*key, "version").unionByName(empty).groupBy(*key).agg(F.max("version").alias("version"))


def merged_covers(people: DataFrame, theirs: DataFrame, faces: DataFrame, photos: DataFrame, to: DataFrame) -> DataFrame:
    """(library, uuid, cover_face, cover_at): the face picked last, a face of the person at that place of the photo (here by content).

    people: library, uuid, cover_face, cover_at of this computer; a pick whose face isn't here is passed over.
    """
    key = ["library", "uuid"]
    picks = _follow(theirs.where("cover_at > 0 and cover_fp is not null").select("library", "source", "uuid", "cover_at", "cover_fp", "cover_x", "cover_y"), to, "uuid")
    at = faces.join(photos.select("library", F.col("id").alias("photo_id"), F.col("fingerprint").alias("cover_fp")), ["library", "photo_id"]).select("library", F.col("person").alias("uuid"), "cover_fp", "x", "y", F.col("id").alias("cover_face"))
    near = picks.join(at, ["library", "uuid", "cover_fp"]).where((F.abs(F.col("x") - F.col("cover_x")) < COVER_NEAR) & (F.abs(F.col("y") - F.col("cover_y")) < COVER_NEAR))
    own = _follow(people.where("cover_face is not null").select("library", "uuid", "cover_face", F.coalesce("cover_at", F.lit(0.0)).alias("cover_at"), F.lit("").alias("source")), to, "uuid")
    all_ = own.unionByName(near.select("library", "uuid", "cover_face", "cover_at", "source"))
    best = all_.groupBy(*key).agg(F.min(F.struct((-F.col("cover_at")).alias("neg"), "source", "cover_face")).alias("b"))
    return best.select(*key, "b.cover_face", (-F.col("b.neg")).alias("cover_at"))


def merged_in(index: dict[str, DataFrame], theirs: dict[str, DataFrame], source: str, version: int) -> dict[str, DataFrame]:
    """The index (see exported) with what other sources sent; a source's own file says nothing new, the same file twice changes nothing."""
    far = {t: df.where(F.col("source") != source) for t, df in theirs.items()}
    links = index["merged"].select("library", "old", "new", "at").unionByName(far["merged"].select("library", "old", "new", "at"))
    people, to = merged_people(index["people"], far["people"], links)
    to = saved(to)
    faces, scans = merged_faces(index["faces"], far["faces"], index["photos"], index["scans"], to)
    faces = saved(faces)
    owners = faces.select("library", F.explode(F.array("person", "was")).alias("uuid")).where("uuid is not null").distinct().join(people.select("library", "uuid"), ["library", "uuid"], "left_anti")
    people = saved(people.unionByName(owners.withColumn("name_at", F.lit(0.0)), allowMissingColumns=True))
    covers = merged_covers(index["people"], far["people"], faces, index["photos"], to)
    two = _follow(index["apart"].select("library", "a", "b").unionByName(far["apart"].select("library", "a", "b")), to, "a", "b")
    here = people.select("library", F.col("uuid").alias("a"))
    apart = two.join(here, ["library", "a"], "left_semi").join(here.withColumnRenamed("a", "b"), ["library", "b"], "left_semi").where("a <> b").select("library", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    answer = ["library", F.round("link", 4).alias("link"), "same", F.round("at", 3).alias("at")]
    answers = index["answers"].select(*answer, F.lit("").alias("s")).union(far["answers"].select(*answer, "source")).groupBy("library", "link", "at").agg(F.min_by("same", F.struct("s", "same")).alias("same"))
    became = links.groupBy("library", "old").agg(F.max("at").alias("at"))
    merged = to.select("library", F.col("uuid").alias("old"), F.col("to").alias("new")).join(became, ["library", "old"], "left").select("library", "old", "new", F.coalesce("at", F.lit(0.0)).alias("at"))
    return {"people": people.join(covers, ["library", "uuid"], "left"), "faces": faces, "photos": index["photos"], "scans": looked_at(scans, faces, index["photos"], far["clean"], version), "merged": merged, "apart": apart, "answers": answers}
