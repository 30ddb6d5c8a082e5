"""People files: export and file round trip, names, merges and faces of other computers, repeated reading."""

import functools
import itertools
import random

from medialake.operators import peoplefile as pf

FACE = "library long, id long, photo_id long, x double, y double, w double, h double, score double, px long, yaw double, roll double, emb array<float>, person string, state int, state_at double, was string, pinned int"


def face(i, photo, x, person=None, state=0, at=0.0, was=None, emb=(3.0, 4.0)):
    return (1, i, photo, x, 0.1, 0.2, 0.2, 0.9, 80, 0.0, 0.0, list(emb), person, state, at, was, 0)


def index(spark, faces=(), people=(), photos=((1, 1, "f1"), (1, 2, "f2"), (1, 3, "f1"), (1, 4, "f4")), scans=(), merged=(), apart=(), answers=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {
        "people": make(people, "library long, uuid string, name string, name_at double, cover_face long, cover_at double"), "faces": make(faces, FACE), "photos": make(photos, "library long, id long, fingerprint string"),
        "scans": make(scans, "library long, photo_id long, version int"), "merged": make(merged, "library long, old string, new string, at double"), "apart": make(apart, "library long, a string, b string"), "answers": make(answers, "library long, link double, same int, at double"),
    }


def union(*files):
    return {t: functools.reduce(lambda a, b: a.unionByName(b), [f[t] for f in files]) for t in pf.TABLES}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_by_files_and_a_second_reading_changes_nothing(spark, tmp_path):
    there = index(spark, [face(7, 1, 0.1, "ana", 1, 5.0), face(8, 3, 0.5, "ana"), face(9, 2, 0.1, None, 2, 6.0, "bo"), face(10, 2, 0.5, emb=(0.0, 0.0))], [(1, "ana", "Ana", 2.0, 7, 3.0), (1, "bo", None, 0.0, None, None)], scans=[(1, i, 2) for i in range(1, 5)], answers=[(1, 0.51234, 1, 2.0)], apart=[(1, "bo", "ana")])
    sent = pf.exported(there, "b", 2)
    pf.write_people(sent, str(tmp_path / "b"))
    (tmp_path / "b" / "people" / "broken.json").write_text('{"library":1,"source":\n{"uuid":"x"}\n')
    read = pf.read_people(spark, str(tmp_path / "b"))
    assert {t: rows(df) for t, df in read.items()} == {t: rows(df) for t, df in sent.items()}
    assert pf.to_write(read, pf.digests(sent))["faces"].isEmpty() and not pf.to_write(read, pf.digests(sent).limit(0))["faces"].isEmpty()
    got = pf.merged_in(index(spark), read, "me", 2)
    assert {(r["photo_id"], r["x"], r["person"], r["state"], r["was"], tuple(round(v, 3) for v in r["emb"])) for r in got["faces"].collect()} == {(1, 0.1, "ana", 1, None, (0.6, 0.8)), (3, 0.1, "ana", 1, None, (0.6, 0.8)), (2, 0.1, None, 2, "bo", (0.6, 0.8))}
    assert {(r["uuid"], r["name"]) for r in got["people"].collect()} == {("ana", "Ana"), ("bo", None)}
    assert got["people"].where("uuid = 'ana'").first()["cover_at"] == 3.0
    assert {tuple(r) for r in got["scans"].collect()} == {(1, i, 2) for i in range(1, 5)} and rows(got["apart"]) == ["Row(library=1, a='ana', b='bo')"]
    again = pf.merged_in(got, read, "me", 2)
    for t, df in again.items():
        assert rows(df) == rows(got[t].select(*df.columns)), t
    assert rows(pf.merged_in(index(spark), read, "b", 2)["faces"]) == []  # one's own file says nothing new


def test_decisions_by_box_and_time(spark):
    mine = index(spark, [face(1, 1, 0.1, "ana", 0, 4.0), face(2, 1, 0.5, "bo", 1, 4.0), face(3, 2, 0.1, None, 0, 0.0)], scans=[(1, 1, 2), (1, 2, 2)])
    make = lambda source, *faces: pf.exported(index(spark, faces), source, 2)
    far = union(make("b", face(1, 1, 0.12, None, 2, 5.0, "cy"), face(2, 1, 0.35, "x", 1, 9.0), face(3, 2, 0.1, "dee", 0, 9.0)), make("c", face(1, 1, 0.1, "eve", 1, 6.0), face(2, 1, 0.5, "x", 1, 4.0)))
    got = pf.merged_in(mine, far, "me", 2)
    assert {(r["id"], r["person"], r["state"], r["state_at"], r["was"]) for r in got["faces"].where("id > 0").collect()} == {(1, "eve", 1, 6.0, None), (2, "bo", 1, 4.0, None), (3, None, 0, 0.0, None)}
    less = pf.merged_in(mine, {t: df.where("source = 'b'") for t, df in far.items()}, "me", 2)
    assert {(r["person"], r["state"], r["was"]) for r in less["faces"].where("id = 1").collect()} == {(None, 2, "ana")}


def test_merges_end_with_the_last_and_cycles_are_cut(spark):
    links = [(1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "a", "z", 0.5), (2, "a", "b", 1.0), (2, "b", "a", 2.0), (3, "q", "q", 1.0), (3, None, "q", 1.0)]
    got = pf.redirects(spark.createDataFrame(links, "library long, old string, new string, at double"))
    assert {tuple(r) for r in got.select("library", "uuid", "to").collect()} == {(1, "a", "c"), (1, "b", "c"), (2, "a", "b")}


def test_three_copies_agree_whatever_the_order(spark):
    rng = random.Random(5)
    names = ["Ana", "ana ", "Bo", None, ""]
    told = [(1, s, u, rng.choice(names), float(t)) for t, (s, u) in enumerate(itertools.product("bc", "pqrst"))]
    rng.shuffle(told)
    mine = [(1, u, rng.choice(names), 4.5) for u in "opq"]
    links = spark.createDataFrame([(1, "t", "p", 1.0)], "library long, old string, new string, at double")
    outs = set()
    for part in (told, told[::-1], sorted(told)):
        df = spark.createDataFrame(part, "library long, source string, uuid string, name string, name_at double").repartition(3)
        people, to = pf.merged_people(spark.createDataFrame(mine, "library long, uuid string, name string, name_at double"), df, links)
        outs.add((tuple(rows(people)), tuple(rows(to))))
        left = [r["name"] for r in people.collect() if r["name"] and r["name"].strip()]
        assert len({n.lower().strip() for n in left}) == len(left)
    assert len(outs) == 1


def test_empty(spark):
    got = pf.merged_in(index(spark, photos=[]), pf.exported(index(spark, photos=[]), "b", 2), "me", 2)
    assert all(df.isEmpty() for df in got.values())
