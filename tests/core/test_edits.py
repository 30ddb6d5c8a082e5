import struct

import pytest

from medialake import schema
from medialake.operators import edits, vocabulary
from medialake.sources import files, headers


def test_marks(spark):
    user = spark.createDataFrame([("a", 0, 2, 0, None, 0, None, None, "x", None, 1.0), ("b", 1, 1, 0, None, 0, None, None, None, None, 1.0)], schema.MEDIA_USER)
    some = spark.createDataFrame([("a",), ("new",), ("a",)], "path string")
    rows = {r["path"]: r for r in edits.edited(user, some, 9.0, rating=7, favorite=1).collect()}
    assert (rows["a"]["rating"], rows["a"]["favorite"], rows["a"]["modified_at"]) == (5, 1, 9.0)
    assert rows["b"]["rating"] == 1 and rows["b"]["modified_at"] == 1.0 and rows["new"]["rating"] == 5
    assert {r["path"]: r["keywords"] for r in edits.with_keywords(user, some.limit(1), 9.0, "X; y").collect()}["a"] == "x; y"
    assert edits.trashed(user, some, 3.0).where("trashed_at = 3.0").count() == 2


def test_forgotten_files_stay_away(spark):
    photos, removed = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", 1.0)], "path string, removed_at double")
    left, gone = edits.forgotten(photos, removed, photos.where("path = 'a'"), 5.0)
    assert [r[0] for r in left.collect()] == ["b"] and [tuple(r) for r in gone.collect()] == [("a", 5.0)]


def test_folders(spark):
    folders = spark.createDataFrame([(1, "u", "A", None, 0), (2, "v", "B", 1, 0), (3, "w", "C", 2, 0)], schema.FOLDERS)
    more = edits.created(folders, "parent_id", 4, "z", "D", 1)
    assert more.where("id = 4").first()["position"] == 1
    assert edits.renamed(folders, 1, "  ").where("id = 1").first()["name"] == "A" and edits.renamed(folders, 1, " Z ").where("id = 1").first()["name"] == "Z"
    with pytest.raises(ValueError):
        edits.moved(folders, 1, 3)
    assert edits.moved(folders, 3, None).where("id = 3").first()["parent_id"] is None
    albums = spark.createDataFrame([(7, "a", "x", 3, None, None, 0), (8, "b", "y", None, None, None, 0)], schema.ALBUMS)
    items = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], schema.ALBUM_ITEMS)
    f, a, i = edits.deleted(folders, albums, items, 2)
    assert [r["id"] for r in f.collect()] == [1] and [r["id"] for r in a.collect()] == [8] and [r["album_id"] for r in i.collect()] == [8]
    assert edits.with_items(items, 8, spark.range(1, 4)).where("album_id = 8").count() == 3


def test_people(spark):
    people = spark.createDataFrame([(1, "José"), (2, None), (3, None)], "id long, name string")
    faces = spark.createDataFrame([(10, 1, 0), (11, 2, 0)], "id long, person_id long, state int")
    apart = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    p, f, marks = edits.person_named(people, faces, apart, 2, "JOSE")
    assert sorted(r["id"] for r in p.collect()) == [1, 3] and {r["person_id"] for r in f.collect()} == {1} and [tuple(r) for r in marks.collect()] == [(1, 3)]
    assert edits.person_named(people, faces, apart, 2, "Ana")[0].where("name = 'Ana'").count() == 1
    assert sorted(r["id"] for r in edits.without_empty_people(people, faces).collect()) == [1, 2]
    assert edits.faces_assigned(faces, faces.where("id = 10"), None, 2).where("id = 10").first()["state"] == 2


def test_first_damage_is_kept(spark):
    known = spark.createDataFrame([("a", "damaged", 1.0, 1.0), ("b", "ok", 1.0, None)], "key string, state string, checked_at double, damaged_at double")
    seen = spark.createDataFrame([("a", "damaged"), ("b", "damaged"), ("c", "ok")], "key string, state string")
    assert {r["key"]: (r["state"], r["damaged_at"]) for r in edits.check_record(known, seen, 5.0).collect()} == {"a": ("damaged", 1.0), "b": ("damaged", 5.0), "c": ("ok", None)}


def test_suggestions(spark):
    photos = spark.createDataFrame([("Rome Cam", "/x/Roma/a.jpg"), (None, "/x/Roma/b.jpg")], "camera_model string, path string")
    people = spark.createDataFrame([("Romy",), (None,)], "name string")
    placed = spark.createDataFrame([("Rome", "Lazio", "Italy")], "city string, region string, country string")
    albums = spark.createDataFrame([("In rome",)], "name string")
    words = vocabulary.vocabulary(photos, people, placed, albums)
    assert [(r["kind"], r["text"]) for r in vocabulary.suggestions(words, "ROM").collect()] == [("person", "Romy"), ("place", "Rome"), ("camera", "Rome Cam"), ("folder", "Roma"), ("album", "In rome")]


def jpeg(orientation):
    text = b"2020:01:02 03:04:05\0"
    ifd = struct.pack("<HHHIHHHHHIII", 3, 0x0112, 3, 1, orientation, 0, 0x010F, 2, 4, 0, 0, 0)
    ifd = struct.pack("<H", 3) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + struct.pack("<HHI4s", 0x010F, 2, 3, b"Ab\0\0") + struct.pack("<HHII", 0x8769, 4, 1, 64) + b"\0\0\0\0"
    tiff = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(64, b"\0") + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), 82) + b"\0\0\0\0" + text
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0\0\0\0"


def box(name, body):
    return struct.pack(">I", len(body) + 8) + name + body


def test_headers(spark, tmp_path):
    assert headers.probe(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == {"width": 3, "height": 4}
    assert headers.probe(jpeg(1)) == {"width": 40, "height": 30, "orientation": 1, "make": "Ab", "taken_text": "2020:01:02 03:04:05"}
    assert (headers.probe(jpeg(6))["width"], headers.probe(jpeg(6))["height"]) == (30, 40)
    mvhd = struct.pack(">IIIII", 0, headers.VIDEO_EPOCH + 100, 0, 1000, 4500) + b"\0" * 80
    tkhd = b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16)
    clip = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd)))
    assert headers.probe(clip) == {"created_at": 100.0, "duration": 4.5, "width": 640, "height": 480}
    assert headers.probe(b"") == headers.probe(b"text") == {} and headers.probe(jpeg(1)[:20]) == {}
    (tmp_path / "a.jpg").write_bytes(jpeg(1))
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = headers.probed(files.listing(spark, str(tmp_path), ("jpg", "txt"))).collect()
    assert [(r["width"], r["make"], r["duration"]) for r in rows] == [(40, "Ab", None)]
    assert headers.xmp('<x xmp:Rating="5"><dc:title>T</dc:title></x>') == {"xmp:Rating": "5", "dc:title": "T"}


def test_face_decisions(spark):
    from medialake.operators import merge

    schema_ = "photo string, id long, box struct<x:double,y:double,w:double,h:double>, person string, state int, state_at double"
    mine = spark.createDataFrame([("p", 1, (0.0, 0.0, 1.0, 1.0), "a", 0, 5.0), ("p", 2, (5.0, 5.0, 1.0, 1.0), "b", 1, 9.0), ("q", 3, (0.0, 0.0, 1.0, 1.0), None, 0, None)], schema_)
    theirs = spark.createDataFrame([("p", 1, (0.1, 0.0, 1.0, 1.0), "c", 1, 6.0), ("p", 2, (5.0, 5.0, 1.0, 1.0), "d", 1, 9.0), ("q", 3, (0.9, 0.9, 1.0, 1.0), "e", 1, 1.0)], schema_)
    rows = {r["id"]: r["person"] for r in merge.face_decisions(mine, theirs).collect()}
    assert rows == {1: "c", 2: "b", 3: None, -4: "e"}
    people = spark.createDataFrame([(3, "Zoé"), (1, "zoe"), (2, None)], "id long, name string")
    assert {r["id"]: r["keep"] for r in merge.one_per_name(people).collect()} == {1: 1, 2: 2, 3: 1}
    seen = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "name string, size long, mtime double")
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 1.0)], "name string, size long, mtime double")
    assert sorted(r["name"] for r in merge.to_pull(now, seen).collect()) == ["b", "c"]
