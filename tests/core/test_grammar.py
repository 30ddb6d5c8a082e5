"""Readings of searches that the driver's tables don't show."""

from datetime import date

import pytest

from medialake.operators import grammar

TODAY = date(2024, 3, 6)  # a Wednesday


@pytest.fixture(scope="module")
def words(spark):
    people = spark.createDataFrame([(1, "Ana María López"), (2, "Ana"), (3, "Luis Pérez"), (4, "Luis Soto"), (5, None)], "id long, name string")
    places = spark.createDataFrame([("Santo Domingo",), ("Miami",), (None,)], "name string")
    named = spark.createDataFrame([("event", 7, "Miami trip"), ("album", 8, "Navidad 2018"), ("folder", 9, "navidad 2018"), ("album", 11, "Navidad 2018"), ("album", 10, "De"), ("album", 12, "2020")], "kind string, id long, name string")
    cameras = spark.createDataFrame([("Canon EOS R5",), ("miami",)], "name string")
    return grammar.library_words(people, places, named, cameras).union(grammar.fixed_words(spark, TODAY)).cache()


def read(spark, words, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in grammar.read(rows, words).orderBy("id", "position").collect():
        out[r["id"]].append(((("-" if r["negative"] else "") + r["kind"]), r["value"], tuple(sorted(r["keys"]))))
    return list(out.values())


def test_readings(spark, words):
    texts = [
        "Ana María López en Miami", "ana luis", "Miami trip 2019", '"navidad 2018" -Luis', "de de -x", "", None, "  ", "mar 2020 mar junio jun", "la semana pasada", "2021-2019 2019-2021 2019 to 2020",
        "canon eos r5 santo domingo", "-4k -raw -5 -3.5", '"dos palabras" "Miami"', "4 stars 4+ star 4 ★★ 2020", "hoy, ayer; este mes", "de la", "2023-13 2023-02-29 2023-12",
    ]
    got = read(spark, words, *texts)
    assert got[0] == [("person", "ana maria lopez", ("p:1",)), ("place", "miami", ("l:miami",))]
    assert got[1] == [("person", "ana", ("p:2",)), ("person", "luis", ("p:3", "p:4"))]  # a whole name before a first name
    assert got[2] == [("event", "miami trip", ("e:7",)), ("date", "2019", ("y:2019",))]
    assert got[3] == [("album", "navidad 2018", ("a:11", "a:8")), ("-person", "luis", ("p:3", "p:4"))]
    assert got[4] == [("-word", "x", ("w:x",))]  # a little word is no name
    assert got[5] == got[6] == got[7] == []
    assert got[8] == [("date", "2020-03", ("m:2020-03",)), ("word", "mar", ("w:mar",)), ("date", "6", ("o:6",)), ("word", "jun", ("w:jun",))]
    assert got[9] == [("phrase", "last_week", tuple(f"d:2024-02-{k}" for k in range(26, 30)) + tuple(f"d:2024-03-0{k}" for k in range(1, 4)))]
    assert [t[1] for t in got[10]] == ["2021-2019", "2019-2021", "2019-2020"] and got[10][0][0] == "word"
    assert [t[:2] for t in got[11]] == [("camera", "canon eos r5"), ("place", "santo domingo")]
    assert [t[:2] for t in got[12]] == [("-type", "4k"), ("-type", "raw"), ("word", "-5"), ("word", "-3.5")]
    assert [t[:2] for t in got[13]] == [("word", "dos palabras"), ("place", "miami")]
    assert [t[::2] for t in got[14]] == [("rating", ("r:4",)), ("rating", ("r:4", "r:5")), ("word", ("w:4",)), ("rating", ("r:2",)), ("date", ("y:2020",))]
    assert [t[1] for t in got[15]] == ["today", "yesterday", "this_month"]
    assert got[16] == [("word", "de", ("w:de",)), ("word", "la", ("w:la",))]
    assert [t[0] for t in got[17]] == ["word", "word", "date"]


def test_photos_of_searches(spark, words):
    keys = spark.createDataFrame([(1, "p:2"), (1, "y:2020"), (2, "p:2"), (2, "t:videos"), (3, "y:2020"), (3, "y:2021"), (4, "p:3"), (4, "p:4")], "photo long, key string")
    photos = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    searches = spark.createDataFrame([(1, "ana 2020"), (2, "2020 Ana"), (3, "-videos"), (4, "luis"), (5, "2020-2021 -ana"), (6, "nothing"), (7, None), (8, "-ana -luis")], "id long, text string")
    terms = grammar.read(searches, words)
    found = {}
    forms = {r["id"]: r["form"] for r in grammar.searched_forms(terms).collect()}
    for r in grammar.matches(terms, keys, photos).collect():
        found.setdefault(r["form"], set()).add(r["photo"])
    assert forms[1] == forms[2]
    assert [found.get(forms.get(i), set()) for i in range(1, 9)] == [{1}, {1}, {1, 3, 4, 5}, {4}, {3}, set(), set(), {3, 5}]
    counts = {r["id"]: r["photos"] for r in grammar.found_counts(searches, terms, keys, photos).collect()}
    assert counts == {1: 1, 2: 1, 3: 4, 4: 1, 5: 1, 6: 0, 7: 0, 8: 2}
    assert grammar.found_counts(searches.limit(0), terms.limit(0), keys, photos).count() == 0
