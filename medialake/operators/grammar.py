"""What is meant by searches: a table of texts becomes terms, and terms find photos.

All searches are read at once. Runs of up to six words are joined with the library's vocabulary and with
fixed words; dates are read off the words themselves. Each place of a search keeps its best reading, and a
fold over the places takes them from left to right. A term stands for keys that photos have (any of them
will do); searches are then joined with photos by key, and a photo is found if all terms of a search say so.

Names whose words stand in another order, keyed words (``type:``), before and after, days written out and
sizes aren't read. Words that mean nothing are looked for as whole words.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import located
from ..functions.text import folded
from ..shared import saved
from .rules import is_screenshot, is_video

# Words of two languages.
MONTHS = {
    "enero": 1, "ene": 1, "january": 1, "jan": 1, "febrero": 2, "feb": 2, "february": 2, "marzo": 3, "mar": 3, "march": 3, "abril": 4, "abr": 4, "april": 4, "apr": 4, "mayo": 5, "may": 5,
    "junio": 6, "jun": 6, "june": 6, "julio": 7, "jul": 7, "july": 7, "agosto": 8, "ago": 8, "august": 8, "aug": 8, "septiembre": 9, "setiembre": 9, "sep": 9, "sept": 9, "september": 9,
    "octubre": 10, "oct": 10, "october": 10, "noviembre": 11, "nov": 11, "november": 11, "diciembre": 12, "dic": 12, "december": 12, "dec": 12,
}
MONTHS_ALONE = ("junio", "julio", "mayo", "abril", "marzo", "enero")
WEEKDAYS = {
    "domingo": 0, "domingos": 0, "sunday": 0, "sundays": 0, "lunes": 1, "monday": 1, "mondays": 1, "martes": 2, "tuesday": 2, "tuesdays": 2, "miercoles": 3, "wednesday": 3, "wednesdays": 3,
    "jueves": 4, "thursday": 4, "thursdays": 4, "viernes": 5, "friday": 5, "fridays": 5, "sabado": 6, "sabados": 6, "saturday": 6, "saturdays": 6,
}
STOPWORDS = (
    "y", "e", "and", "con", "with", "juntos", "juntas", "together", "&", "de", "del", "la", "el", "los", "las", "en", "of", "in", "the", "a", "an", "at", "from", "un", "una", "por", "para", "sin", "al", "lo", "o", "or",
    "on", "to", "que", "my", "mi", "mis",
)
KINDS = {
    "videos": ("video", "videos", "videoclip", "videoclips", "clip", "clips"),
    "photos": ("foto", "fotos", "photo", "photos", "imagen", "imagenes", "image", "images"),
    "screenshots": ("captura", "capturas", "screenshot", "screenshots", "pantallazo", "pantallazos"),
    "favorites": ("favorita", "favoritas", "favorito", "favoritos", "favorite", "favorites", "favourite", "favourites"),
    "edited": ("editada", "editadas", "editado", "editados", "edited", "retocada", "retocadas"),
    "vertical": ("vertical", "verticales", "portrait", "retrato", "retratos"),
    "horizontal": ("horizontal", "horizontales", "landscape", "paisaje", "paisajes", "apaisada", "apaisadas"),
    "square": ("cuadrada", "cuadradas", "cuadrado", "square", "squares"),
    "4k": ("4k", "uhd"),
    "raw": ("raw", "crudo"),
}
EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "avif", "webp", "gif", "tif", "tiff", "mov", "mp4", "m4v", "avi", "mkv", "webm", "cr2", "cr3", "nef", "arw", "dng", "raf")
RAW = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "dng", "raw", "erf", "kdc", "mos", "mrw", "x3f", "3fr", "iiq", "rwl", "srw")
PHRASES = {
    "con ubicacion": "located", "with location": "located", "geolocalizadas": "located", "geolocalizada": "located", "located": "located",
    "sin ubicacion": "unlocated", "no location": "unlocated", "without location": "unlocated",
    "con personas": "with_people", "with people": "with_people", "con caras": "with_people", "with faces": "with_people",
    "sin personas": "no_people", "no people": "no_people", "sin caras": "no_people", "without people": "no_people", "sin gente": "no_people",
    "el ano pasado": "last_year", "ano pasado": "last_year", "last year": "last_year", "este ano": "this_year", "this year": "this_year",
    "este mes": "this_month", "this month": "this_month", "el mes pasado": "last_month", "mes pasado": "last_month", "last month": "last_month",
    "esta semana": "this_week", "this week": "this_week", "la semana pasada": "last_week", "semana pasada": "last_week", "last week": "last_week",
    "hoy": "today", "today": "today", "ayer": "yesterday", "yesterday": "yesterday",
}
RANGE_WORDS = ("a", "to", "al", "hasta", "-")
STARS = ("estrella", "estrellas", "star", "stars")
LONGEST = 6
#: Readings in the order in which they are tried at a place; of one kind the longest.
PERSON, LONG_NAME, PLACE, NAME, PHRASE, YEARS, MONTH, DAY, YEAR, WEEKDAY, TYPE, RATING, CAMERA = range(1, 14)
#: Of names that are written alike, the kinds that come first.
NAMED = ("album", "folder", "event")

#: Photos of a block of bit sets, and how many blocks there are unless photos are many; forms that come to a block at once.
LEAST_BLOCK, MOST_BLOCKS, LARGEST_BLOCK = 4_096, 64, 1 << 16
FORMS_AT_ONCE = 1 << 14

VOCABULARY = "gram string, kind string, value string, keys array<string>"


def relative(what: str, today: date) -> list[str]:
    """The keys of a phrase about time."""
    monday = today - timedelta(days=today.weekday() + (7 if what == "last_week" else 0))
    before = today.replace(day=1) - timedelta(days=1)
    return {
        "today": [f"d:{today}"], "yesterday": [f"d:{today - timedelta(days=1)}"], "this_year": [f"y:{today.year}"], "last_year": [f"y:{today.year - 1}"],
        "this_month": [f"m:{today:%Y-%m}"], "last_month": [f"m:{before:%Y-%m}"],
    }.get(what) or ([f"d:{monday + timedelta(days=k)}" for k in range(7)] if what.endswith("week") else [what])


def fixed_words(spark: SparkSession, today: date) -> DataFrame:
    """The vocabulary of every library: (gram, kind, value, keys)."""
    rows = [(w, "month", str(m), [f"o:{m}"]) for w, m in MONTHS.items()]
    rows += [(w, "weekday", str(d), [f"k:{d}"]) for w, d in WEEKDAYS.items()]
    rows += [(w, "type", kind, [f"t:{kind}"]) for kind, words in KINDS.items() for w in words]
    rows += [(w, "type", "." + x, [f"x:{x}"]) for x in EXTENSIONS for w in (x, "." + x)]
    rows += [(w, "phrase", what, relative(what, today)) for w, what in PHRASES.items()]
    return spark.createDataFrame(rows, VOCABULARY)


def library_words(people: DataFrame, places: DataFrame, named: DataFrame, cameras: DataFrame) -> DataFrame:
    """The library's own vocabulary. people: id, name; places: name; named: kind (album, folder, event), id, name; cameras: name.

    A first name stands for all who have it, unless somebody's whole name is just that. Names written alike
    are one; of albums, folders and events of one name the first kind counts, with all its ids.
    """
    name = F.trim(folded(F.col("name")))
    who = people.where("name is not null").select("id", name.alias("full")).where("full <> ''")
    first = F.split_part("full", F.lit(" "), F.lit(1))
    called = who.select("id", F.col("full").alias("gram"), F.lit(1).alias("rank")).union(who.where(first != F.col("full")).select("id", first.alias("gram"), F.lit(2).alias("rank")))
    sides = [
        called.select("gram", F.lit("person").alias("kind"), "rank", F.concat(F.lit("p:"), F.col("id").cast("string")).alias("key")),
        places.where("name is not null").select(name.alias("gram"), F.lit("place"), F.lit(1), F.concat(F.lit("l:"), name)),
        named.where("name is not null").select(name.alias("gram"), F.lit("named"), F.array_position(F.array(*map(F.lit, NAMED)), F.col("kind")).cast("int"), F.concat(F.substring("kind", 1, 1), F.lit(":"), F.col("id").cast("string"))),
        cameras.where("name is not null").select(name.alias("gram"), F.lit("camera"), F.lit(1), F.concat(F.lit("c:"), name)),
    ]
    rows = sides[0].union(sides[1]).union(sides[2]).union(sides[3]).where("gram <> '' and rank > 0")
    best = rows.groupBy("gram", "kind", "rank").agg(F.array_sort(F.collect_set("key")).alias("keys")).groupBy("gram", "kind").agg(F.min(F.struct("rank", "keys")).alias("b"))
    kind = F.when(F.col("kind") == "named", F.element_at(F.array(*map(F.lit, NAMED)), F.col("b.rank"))).otherwise(F.col("kind"))
    return best.select("gram", kind.alias("kind"), F.col("gram").alias("value"), F.col("b.keys").alias("keys"))


def _year(c: Column) -> Column:
    return F.coalesce(c.rlike("^(19|20)[0-9][0-9]$"), F.lit(False))


def _dates(places: DataFrame) -> DataFrame:
    """Readings of the words themselves: years, ranges of years, ISO days and months, ratings."""
    w, n1, n2 = F.col("w"), F.get("words", F.col("start") + 1), F.get("words", F.col("start") + 2)
    none = F.lit(None).cast("struct<rank:int,n:int,kind:string,value:string,keys:array<string>>")
    term = lambda rank, n, kind, value, keys: F.struct(F.lit(rank).alias("rank"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), value.alias("value"), keys.alias("keys"))
    years = lambda a, b: F.transform(F.sequence(a.cast("int"), b.cast("int")), lambda y: F.concat(F.lit("y:"), y.cast("string")))
    two = w.rlike("^(19|20)[0-9]{2}[-–](19|20)[0-9]{2}$") & (F.substring(w, 1, 4) <= F.substring(w, -4, 4))
    apart = _year(w) & F.coalesce(n1.isin(*RANGE_WORDS), F.lit(False)) & _year(n2) & (w <= n2)
    day = F.when(w.rlike("^(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$"), w.try_cast("date"))
    month = w.rlike("^(19|20)[0-9]{2}-(0[1-9]|1[0-2])$")
    stars, plus = F.substring(w, 1, 1).cast("int"), w.endswith("+")
    rated = w.rlike(r"^[1-5]\+?$") & F.coalesce(n1.isin(*STARS), F.lit(False))
    found = F.array(
        F.when(two, term(YEARS, 1, "date", F.concat(F.substring(w, 1, 4), F.lit("-"), F.substring(w, -4, 4)), years(F.substring(w, 1, 4), F.substring(w, -4, 4)))).otherwise(none),
        F.when(apart, term(YEARS, 3, "date", F.concat(w, F.lit("-"), n2), years(w, n2))).otherwise(none),
        F.when(day.isNotNull(), term(DAY, 1, "date", w, F.array(F.concat(F.lit("d:"), w)))).otherwise(none),
        F.when(month, term(DAY, 1, "date", w, F.array(F.concat(F.lit("m:"), w)))).otherwise(none),
        F.when(_year(w), term(YEAR, 1, "date", w, F.array(F.concat(F.lit("y:"), w)))).otherwise(none),
        F.when(rated, term(RATING, 2, "rating", w, F.transform(F.sequence(stars, F.when(plus, 5).otherwise(stars)), lambda r: F.concat(F.lit("r:"), r.cast("string"))))).otherwise(none),
        F.when(w.rlike("^★{1,5}$"), term(RATING, 1, "rating", F.length(w).cast("string"), F.array(F.concat(F.lit("r:"), F.length(w).cast("string"))))).otherwise(none),
    )
    return places.where("mode = 'plain'").select("id", "start", F.explode(F.filter(found, lambda t: t.isNotNull())).alias("t")).select("id", "start", "t.*")


def read(searches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, position, length, kind, value, keys, negative) of the terms of each search, words included.

    searches: id, text; vocabulary: library_words() and fixed_words(). position and length count words, from
    0. ``-name`` and ``-videos`` turn a term around; other words with a dash are words not to be there (kind
    word, negative). A quoted phrase is a name or stays together. Little words are left out, unless there is
    nothing else. Null and empty searches have no terms; each id is one search. Searches of one text are read once.
    """
    texts = searches.where("text is not null").groupBy("text").agg(F.min("id").alias("__first"))
    terms = _read(texts.select(F.col("__first").alias("id"), "text"), vocabulary).withColumnRenamed("id", "__first")
    return searches.select("id", "text").join(texts, "text").join(terms, "__first").drop("text", "__first")


def _read(searches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """read() of searches that have different texts."""
    raw = F.regexp_extract_all("text", F.lit(r'([^\s"]*"[^"]*"|\S+)'), 1)
    bare = lambda t: F.regexp_replace(folded(t), '^[",;]+|[",;]+$', "")
    texts = searches.where("text is not null").select("id", raw.alias("raw")).withColumn("words", F.transform("raw", bare))
    places = texts.select("id", "words", F.posexplode("raw").alias("start", "token")).withColumn("w", F.get("words", F.col("start")))
    minus = F.startswith("token", F.lit("-")) & (F.length("token") > 1) & ~F.regexp_replace(F.substring("token", 2, 1 << 20), r"\.", "").rlike("^[0-9]+$")
    quoted = F.startswith("token", F.lit('"')) & F.endswith("token", F.lit('"')) & (F.length("token") > 2)
    places = places.withColumn("mode", F.when(minus, "minus").when(quoted, "quoted").otherwise("plain"))
    own = F.when(F.col("mode") == "minus", bare(F.substring("token", 2, 1 << 20))).otherwise(F.col("w"))
    most = F.when(F.col("mode") == "quoted", 1).otherwise(F.least(F.lit(LONGEST), F.size("words") - F.col("start")))
    runs = places.select("id", "start", "mode", "words", own.alias("w"), F.explode(F.sequence(F.lit(1), most)).alias("n"))
    runs = runs.withColumn("gram", F.array_join(F.concat(F.array("w"), F.slice("words", F.col("start") + 2, F.col("n") - 1)), " ")).withColumn("next", F.get("words", F.col("start") + 1))
    hits = runs.join(vocabulary.withColumnRenamed("kind", "k"), "gram")
    named = F.col("k").isin(*NAMED)
    usual = (
        F.when(F.col("k") == "person", PERSON).when(named & (F.col("n") > 1), LONG_NAME).when((F.col("k") == "place") & (F.col("n") <= 3), PLACE)
        .when(named & ~F.col("gram").isin(*STOPWORDS) & ~F.col("gram").rlike("^[0-9]+$"), NAME).when(F.col("k") == "phrase", PHRASE)
        .when((F.col("k") == "month") & (_year(F.col("next")) | (F.length("gram") > 4) | F.col("gram").isin(*MONTHS_ALONE)), MONTH)
        .when(F.col("k") == "weekday", WEEKDAY).when(F.col("k") == "type", TYPE).when(F.col("k") == "camera", CAMERA)
    )
    rank = F.when(F.col("mode") == "plain", usual).when(F.col("mode") == "quoted", F.when(named, 1).when(F.col("k") == "person", 2).when(F.col("k") == "place", 3)).when(F.col("k") == "person", 1).when((F.col("k") == "type") & (F.col("n") == 1), 2)
    dated = (F.col("mode") == "plain") & (F.col("k") == "month") & _year(F.col("next"))
    of_year = F.concat("next", F.lit("-"), F.lpad("value", 2, "0"))
    hits = hits.select(
        "id", "start", rank.alias("rank"), F.when(dated, 2).otherwise(F.col("n")).alias("n"), F.when(F.col("k").isin("month", "weekday"), "date").when(F.col("k") == "phrase", "phrase").otherwise(F.col("k")).alias("kind"),
        F.when(dated, of_year).otherwise(F.col("value")).alias("value"), F.when(dated, F.array(F.concat(F.lit("m:"), of_year))).otherwise(F.col("keys")).alias("keys"),
    ).where("rank is not null")
    best = hits.unionByName(_dates(places)).groupBy("id", "start").agg(F.min(F.struct("rank", (-F.col("n")).alias("shorter"), "kind", "value", "keys")).alias("b"))
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.shorter")).alias("n"), "b.kind", "b.value", "b.keys"))).alias("best"))
    taken = F.aggregate(
        "best", F.struct(F.lit(0).alias("next"), F.filter("best", lambda t: F.lit(False)).alias("terms")),
        lambda s, t: F.when(t["start"] >= s["next"], F.struct((t["start"] + t["n"]).alias("next"), F.array_append(s["terms"], t).alias("terms"))).otherwise(s), lambda s: s["terms"],
    )
    whole = places.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "w", "token", "mode"))).alias("all")).join(best, "id", "left").withColumn("terms", taken)
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,n:int,kind:string,value:string,keys:array<string>>>"))
    whole = whole.withColumn("terms", terms)
    free = F.filter("all", lambda p: ~F.exists("terms", lambda t: (p["start"] >= t["start"]) & (p["start"] < t["start"] + t["n"])))
    whole = whole.withColumn("free", free)
    little = lambda p: (p["mode"] == "plain") & p["w"].isin(*STOPWORDS)
    nothing_else = (F.size("terms") == 0) & ~F.exists("free", lambda p: (p["mode"] != "minus") & ~little(p))
    words = F.filter("free", lambda p: ~little(p) | F.col("lone"))
    said = lambda p: F.when(p["mode"] == "minus", bare(F.substring(p["token"], 2, 1 << 20))).otherwise(p["w"])
    modes = whole.withColumn("lone", nothing_else & ~F.exists("all", lambda p: p["mode"] == "minus")).select(
        "id",
        F.concat(
            F.transform("terms", lambda t: F.struct(t["start"].alias("position"), t["n"].alias("length"), t["kind"].alias("kind"), t["value"].alias("value"), t["keys"].alias("keys"))),
            F.transform(words, lambda p: F.struct(p["start"].alias("position"), F.lit(1).alias("length"), F.lit("word").alias("kind"), said(p).alias("value"), F.array(F.concat(F.lit("w:"), said(p))).alias("keys"))),
        ).alias("t"),
        "all",
    )
    out = modes.select("id", "all", F.explode("t").alias("t"))
    return out.select("id", "t.*", (F.get("all", F.col("t.position"))["mode"] == "minus").alias("negative"))


def photo_keys(photos: DataFrame) -> DataFrame:
    """(photo, key) of what photos say themselves: date taken, kind, extension, stars, camera, place or none, words of the file name."""
    at = F.timestamp_seconds("taken_at")
    video, ext = is_video(), F.lower("ext")
    flag = lambda cond, key: F.when(F.coalesce(cond, F.lit(False)), F.lit(key))
    wide, high = F.col("width"), F.col("height")
    keys = [
        F.concat(F.lit("y:"), F.date_format(at, "yyyy")), F.concat(F.lit("m:"), F.date_format(at, "yyyy-MM")), F.concat(F.lit("d:"), F.date_format(at, "yyyy-MM-dd")), F.concat(F.lit("o:"), F.month(at).cast("string")), F.concat(F.lit("k:"), (F.dayofweek(at) - 1).cast("string")),
        flag(video, "t:videos"), flag(~video, "t:photos"), flag(is_screenshot(), "t:screenshots"), flag(F.col("favorite") == 1, "t:favorites"), flag(F.col("edit_version") > 0, "t:edited"), flag(high > wide, "t:vertical"), flag(wide > high, "t:horizontal"),
        flag((wide > 0) & (F.abs(wide - high) * 20 <= wide), "t:square"), flag(video & (F.greatest(wide, high) >= 3840), "t:4k"), flag(ext.isin(*RAW), "t:raw"), F.concat(F.lit("x:"), ext), F.concat(F.lit("r:"), F.col("rating").cast("string")), F.concat(F.lit("c:"), folded(F.col("camera_model"))),
        flag(located("gps_lat", "gps_lon"), "located"), flag(~F.coalesce(located("gps_lat", "gps_lon"), F.lit(False)), "unlocated"),
    ]
    words = F.transform(F.filter(F.split(folded(F.col("filename")), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    own = F.array_distinct(F.concat(F.filter(F.array(*keys), lambda k: k.isNotNull()), F.coalesce(words, F.array().cast("array<string>"))))
    return photos.select(F.col("id").alias("photo"), F.explode(own).alias("key"))


def people_keys(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(photo, key) of who is in photos, and whether anybody is. faces: photo_id, person_id."""
    seen = faces.select(F.col("photo_id").alias("photo"), F.concat(F.lit("p:"), F.col("person_id").cast("string")).alias("key")).where("key is not null")
    anybody = faces.select(F.col("photo_id").alias("photo")).distinct()
    ids = photos.select(F.col("id").alias("photo"))
    return seen.distinct().union(ids.join(anybody, "photo", "left_semi").select("photo", F.lit("with_people"))).union(ids.join(anybody, "photo", "left_anti").select("photo", F.lit("no_people")))


def _from_all(asked: Column) -> Column:
    """A form that only turns terms around starts from all photos, whose key is ``*``."""
    all_ = F.array(F.struct(F.lit(False).alias("negative"), F.array(F.lit("*")).alias("keys")))
    return F.when(F.exists(asked, lambda t: ~t["negative"]), asked).otherwise(F.concat(asked, all_))


def matches(terms: DataFrame, keys: DataFrame, photos: DataFrame) -> DataFrame:
    """(form, photo): the photos of each different search, and (id, form) is searched_forms(terms).

    Searches that ask for the same keys are one form. A form's photos are those that have a key of each term
    that isn't turned around, and none of the others; a form that only has others starts from all photos.
    """
    asked = searched_forms(terms).groupBy("form").agg(F.first("asked").alias("asked"))
    asked = asked.withColumn("asked", _from_all(F.col("asked")))
    parts = asked.select("form", F.size(F.filter("asked", lambda t: ~t["negative"])).alias("need"), F.posexplode("asked").alias("part", "t"))
    each = parts.select("form", "need", "part", "t.negative", F.explode("t.keys").alias("key"))
    wanted = keys.union(photos.select(F.col("id").alias("photo"), F.lit("*").alias("key"))).join(each.select("key").distinct(), "key", "left_semi")  # what anybody asks for
    hits = each.join(wanted, "key")
    some = hits.where("not negative").select("form", "need", "part", "photo").distinct().groupBy("form", "need", "photo").agg(F.count("*").alias("n")).where("n = need")
    return some.select("form", "photo").join(hits.where("negative").select("form", "photo"), ["form", "photo"], "left_anti")


def searched_forms(terms: DataFrame) -> DataFrame:
    """(id, form, asked): what each search asks for, whatever the order of its terms; form is its hash."""
    asked = terms.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("negative", F.array_sort("keys").alias("keys")))).alias("asked"))
    return asked.select("id", F.sha2(F.to_json("asked"), 256).alias("form"), "asked")


def _photo_bits(wanted: DataFrame, blocks: int) -> DataFrame:
    """(block, key, bits): photos are dealt to blocks by a hash; which of a block's photos have a key, packed."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(rows["photo"].to_numpy(), return_inverse=True)
        names, of = np.unique(rows["key"].to_numpy().astype(str), return_inverse=True)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(names) + 1))
        size = -(-len(ids) // 64) * 64
        out = []
        for k in range(len(names)):
            has = np.zeros(size, bool)
            has[at[order[ends[k] : ends[k + 1]]]] = True
            out.append(np.packbits(has).tobytes())
        return pd.DataFrame({"block": key[0], "key": names, "bits": out})

    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("photo"), F.lit(blocks)).cast("int"))
    return saved(dealt.groupBy("block").applyInPandas(pack, "block int, key string, bits binary"))


def counted(terms: DataFrame, keys: DataFrame, photos: DataFrame) -> DataFrame:
    """(form, photos): how many photos each form of matches() finds, without making the pairs.

    A key is a set of bits over the photos of a block. Forms come in chunks to each block, where a term is
    the union of its keys' sets and a form what is left of the terms' sets. Forms found nowhere have no row.
    """
    asked = searched_forms(terms).groupBy("form").agg(F.first("asked").alias("asked"))
    forms = saved(asked.withColumn("asked", _from_all(F.col("asked"))))
    every = photos.select(F.col("id").alias("photo"), F.lit("*").alias("key"))
    wanted = keys.union(every).join(forms.select(F.explode("asked.keys").alias("keys")).select(F.explode("keys").alias("key")).distinct(), "key", "left_semi")
    n = photos.count()
    blocks = max(1, min(MOST_BLOCKS, n // LEAST_BLOCK), -(-n // LARGEST_BLOCK))
    bits = _photo_bits(wanted, blocks)
    chunks = max(1, -(-forms.count() // FORMS_AT_ONCE))
    chunk = forms.withColumn("chunk", F.pmod(F.xxhash64("form"), F.lit(chunks)).cast("int"))
    left = chunk.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = bits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def count(key, some: pd.DataFrame, sets_: pd.DataFrame) -> pd.DataFrame:
        has = {k: np.frombuffer(b, "u8") for k, b in zip(sets_["key"], sets_["bits"])}
        none = np.zeros(len(next(iter(has.values()))) if has else 0, "u8")
        made: dict = {}

        def term(names: tuple) -> np.ndarray:
            if len(names) == 1:
                return has.get(names[0], none)
            if names not in made:
                found = [has[k] for k in names if k in has]
                made[names] = np.bitwise_or.reduce(found) if found else none
            return made[names]

        out = []
        for asked_ in some["asked"]:
            left_ = None
            for t in sorted(asked_, key=lambda t: t["negative"]):
                own = term(tuple(t["keys"]))
                left_ = own if left_ is None else left_ & ~own if t["negative"] else left_ & own
                if not left_.any():
                    break
            out.append(int(np.bitwise_count(left_).sum()))
        return pd.DataFrame({"form": some["form"], "n": pd.Series(out, dtype="int64")})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(count, "form string, n long")
    return found.where("n > 0").groupBy("form").agg(F.sum("n").alias("photos"))


def found_counts(searches: DataFrame, terms: DataFrame, keys: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, photos): how many photos each search finds; searches without terms find none."""
    forms = searched_forms(terms).select("id", "form")
    counts = counted(terms, keys, photos)
    return searches.select("id").join(forms.join(counts, "form"), "id", "left").select("id", F.coalesce("photos", F.lit(0)).cast("long").alias("photos"))
