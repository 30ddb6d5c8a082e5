"""Semantics that the driver's tables can't show: nulls, wildcards, ties, edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from medialake.functions import dates, geo, pixels, text
from medialake.operators import browse, components, dupes, events, ingest, merge, people, places, rules, summary
from medialake.plans import upkeep

PHOTO = "id long, path string, filename string, ext string, bytes long, taken_at double, added_at double, favorite int, hidden int, trashed_at double, edit_version int, rating int, width int, height int, gps_lat double, gps_lon double, camera_model string, in_library int, paired_to long, fingerprint string, title string"


def photo(**k):
    base = dict(id=1, path="/a/x.jpg", filename="x.jpg", ext="jpg", bytes=10, taken_at=100.0, added_at=1.0, favorite=0, hidden=0, trashed_at=None, edit_version=0, rating=0, width=10, height=10, gps_lat=None, gps_lon=None, camera_model=None, in_library=1, paired_to=None, fingerprint="f", title=None)
    return tuple((base | k).values())


@pytest.fixture
def photos(spark):
    return lambda *rows: spark.createDataFrame([photo(**({"id": i} | r)) for i, r in enumerate(rows)], PHOTO)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def rule(df, *of, match="all", as_of=1000.0):
    return ids(df.where(rules.combined([rules.Rule(*r) for r in of], match, as_of)))


def test_rules_on_nulls(photos):
    df = photos({"title": None, "rating": None}, {"title": "A_c", "rating": 3}, {"title": "abc", "rating": 0})
    assert rule(df, ("title", "is_not", "abc")) == [0, 1]
    assert rule(df, ("title", "contains", "a_c")) == [1, 2]  # _ is a wildcard
    assert rule(df, ("title", "contains", "")) == [0, 1, 2]
    assert rule(df, ("rating", "is", -1)) == [] and rule(df, ("rating", "is_not", -1)) == [1, 2] and rule(df, ("rating", "<", 5)) == [1, 2]
    assert rule(df, ("rating", ">", "x")) == [0, 1, 2] == rule(df, ("nothing", "is", 1)) == rule(df)
    assert rule(df, ("rating", ">", 1), ("title", "is", "ABC"), match="any") == [1, 2]


def test_dates_and_media(photos):
    df = photos({"taken_at": None}, {"taken_at": 999.0, "ext": "MOV"}, {"taken_at": 0.0, "ext": None})
    assert rule(df, ("taken_at", "last_days", 0.001)) == [1] and rule(df, ("taken_at", "before", 500)) == [2]
    assert rule(df, ("media", "is", "video")) == [1] and rule(df, ("media", "is", "photo")) == [0, 2]
    assert ids(df.where(rules.taken_between(0, 999))) == [2]


def test_scopes(photos):
    df = photos({}, {"hidden": 1}, {"trashed_at": 5.0}, {"paired_to": 0}, {"favorite": 1, "fingerprint": "g"}, {"hidden": None})
    assert ids(browse.scope(df, "library")) == [0, 4, 5] and ids(browse.scope(df, "hidden")) == [1] and ids(browse.scope(df, "trash")) == [2]
    assert ids(browse.scope(df, "duplicates")) == [0, 5]
    assert ids(browse.filtered(df, [])) == ids(browse.filtered(df, ["what"])) == [0, 1, 2, 3, 4, 5]


def test_pages_follow_each_other(photos):
    df = photos(*({"taken_at": float(t)} for t in (5, 3, 3, 3, 9, 1)), {"taken_at": None})
    seen, at, last = [], None, None
    while rows := browse.page_after(df, at, last, 2).collect():
        seen += [r["id"] for r in rows]
        at, last = rows[-1]["taken_at"], rows[-1]["id"]
    assert seen == [4, 0, 1, 2, 3, 5]


def test_text(spark):
    df = spark.createDataFrame([("Señor ÉCOLE",), (None,), ("img12",), ("img9",)], "t string")
    assert [r[0] for r in df.select(text.fold("t")).collect()] == ["senor ecole", None, "img12", "img9"]
    assert [r[0] for r in df.where(text.contains_folded("t", "ecole")).collect()] == ["Señor ÉCOLE"]
    assert [r["t"] for r in df.where("t like 'img%'").orderBy(text.natural_key("t")).collect()] == ["img9", "img12"]
    one = spark.range(1).select(text.merge_keywords(F.lit("a; B,a"), F.lit("b;c")), text.words_match(F.lit("summer in rome"), F.lit("ro sum")), text.within_one_edit(F.lit("rome"), F.lit("romes")), text.size_text(F.lit(999)), text.size_text(F.lit(1500)), text.duration_text(F.lit(3661.2))).first()
    assert tuple(one) == ("a; B; c", True, True, "999 B", "1.5 kB", "1:01:01")


def test_zones_do_not_depend_on_the_session(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(dates.period(F.lit(1704067200.0), "day", "America/New_York")).first()[0] == "2023-12-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_dates_in_names(spark):
    df = spark.createDataFrame([("IMG_20231345_20210203.jpg", "/a/2020-02-30/2019-05-06/x/f.jpg"), ("x", "/2018-01-01/a/b/c/f.jpg")], "n string, p string")
    assert [tuple(map(str, r)) for r in df.select(dates.date_from_name("n", 2025), dates.date_from_folders("p")).collect()] == [("2021-02-03", "2019-05-06"), ("None", "None")]


def test_coordinates(spark):
    texts = ["48.85, 2.35", "https://maps.example/@-33.5,151.25,12z", "40°26'46\"N 79°58'56\"W", "99, 0", "no"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(geo.coordinates("t")).collect()]
    assert found[0] == (48.85, 2.35) and found[1] == (-33.5, 151.25) and found[3] is None and found[4] is None
    assert abs(found[2][0] - 40.446) < 1e-3 and abs(found[2][1] + 79.982) < 1e-3


def test_sessions_carry_the_last_city(spark):
    h = 3600.0
    rows = [(1, 1, 0.0, "a"), (1, 2, h, None), (1, 3, 3 * h, "b"), (1, 4, 3 * h, "b"), (1, 5, 10 * h, None), (1, 6, None, "c"), (2, 7, 0.0, None), (2, 8, 2 * h, "z")]
    df = spark.createDataFrame(rows, "k int, id int, taken_at double, city string")
    assert {r["id"]: r["session"] for r in events.sessions(df, "k").collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 7: 1, 8: 1}


def test_spans_include_their_end(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((9.9, 10.0, 86_410.0, 86_410.0011))], "k int, id int, taken_at double")
    spans = spark.createDataFrame([(1, 7, 10.0, 86_410.0)], "k int, s int, start_at double, end_at double")
    assert sorted(r["id"] for r in events.in_spans(rows, spans, "k", "s").collect()) == [1, 2]
    assert ids(events.outside(rows, spans, "k")) == [0, 3]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7), (200, 200)], "a long, b long")
    found = {r["id"]: r["root"] for r in components.components(edges).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_folders_inside_themselves_are_an_error(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, parent_id long")
    assert summary.closure(tree).count() == 15
    assert not summary.may_move(tree, 2, 5) and summary.may_move(tree, 5, 1)
    with pytest.raises(ValueError):
        summary.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"))


def test_merges(spark):
    schema = "album long, item long, added double, removed double"
    mine = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, 5.0, 6.0), (1, 3, 5.0, 5.0)], schema)
    theirs = spark.createDataFrame([(1, 1, None, 9.0), (1, 2, 7.0, None), (1, 4, None, None)], schema)
    assert sorted((r["album"], r["item"]) for r in merge.membership(mine, theirs).collect()) == [(1, 2), (1, 3)]
    a = spark.createDataFrame([("p", 1, 5.0), ("q", 1, None)], "path string, favorite int, modified_at double")
    b = spark.createDataFrame([("p", 2, 5.0), ("q", 2, 1.0), ("r", 2, 3.0)], "path string, favorite int, modified_at double")
    gone = spark.createDataFrame([("r", 3.0)], "path string, deleted_at double")
    assert sorted((r["path"], r["favorite"]) for r in merge.marks(a, b, gone).collect()) == [("p", 1), ("q", 2)]


def test_upsert_keeps_what_was_set_by_hand(spark):
    schema = "path string, bytes long, mtime double, taken_at double, date_source string, gps_lat double, gps_lon double, gps_manual int"
    old = spark.createDataFrame([("m", 1, 1.0, 9.0, "manual", 1.0, 1.0, 1), ("r", 1, 1.0, 9.0, "recorded", None, None, 0), ("gone", 1, 1.0, 1.0, "exif", None, None, 0)], schema)
    new = spark.createDataFrame([("m", 2, 2.0, 8.0, "exif", 2.0, 2.0, 0), ("r", 2, 2.0, 8.0, "mtime", 3.0, 3.0, 0), ("n", 2, 2.0, 8.0, "folder", None, None, 0)], schema)
    found = {r["path"]: tuple(r)[1:] for r in ingest.upserted(old, new).collect()}
    assert found == {"m": (2, 2.0, 9.0, "manual", 1.0, 1.0, 1), "r": (2, 2.0, 9.0, "recorded", 3.0, 3.0, 0), "n": (2, 2.0, 8.0, "folder", None, None, 0), "gone": (1, 1.0, 1.0, "exif", None, None, 0)}


def test_dated(spark):
    df = spark.createDataFrame([("/l/2020-05-06/a.jpg", "a.jpg", None, None, 1588723300.0), ("/l/2020-05-06/a.jpg", "a.jpg", None, None, 5.0), ("/l/a.jpg", "P20200506.jpg", None, None, 5.0), ("/l/a.jpg", "a.jpg", 7.0, "exif", 5.0), ("/l/a.jpg", "a.jpg", None, None, 5.0)], "path string, filename string, taken_at double, date_source string, mtime double")
    assert [(r["taken_at"], r["date_source"]) for r in ingest.dated(df, 2025).collect()] == [(1588723300.0, "folder"), (1588766400.0, "folder"), (1588723200.0, "filename"), (7.0, "exif"), (5.0, "mtime")]


def test_cuts(spark):
    cuts = F.expr("array(struct(2.0D AS a, 4.0D AS b), struct(0.0D AS a, 1.0D AS b), struct(3.0D AS a, 5.0D AS b))")
    assert [tuple(p) for p in spark.range(1).select(ingest.kept_pieces(F.lit(0.0), F.lit(6.0), cuts)).first()[0]] == [(1.0, 2.0), (5.0, 6.0)]


def test_towns_across_the_date_line_and_the_pole(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 10.0), (3, 0.0, 0.0), (4, -70.0, 5.0)], "id long, lat double, lon double")
    towns = spark.createDataFrame([(1, "line", "x", 0.0, -179.9, 5), (2, "pole", "y", 89.9, -170.0, 5)], "id long, name string, country string, lat double, lon double, population long")
    assert {r["id"]: r["town_id"] for r in places.nearest(points, towns).collect()} == {1: 1, 2: 2}
    assert {r["id"]: (r["city"], r["country"]) for r in places.locate(points, towns).collect()} == {1: ("line", "x"), 2: ("pole", "y"), 3: (None, None), 4: (None, "Antarctica")}


def walked_pins(rows, zoom, pixels=34.0):
    """(items, spots) of each pin by the sequential rule."""
    radius = pixels * 360.0 / (256 * 2.0**zoom)
    cell = lambda r: (int(r[1] / radius), int(r[2] / radius))
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    taken, out = [False] * len(rows), []
    for i, seed in enumerate(rows):
        if taken[i]:
            continue
        squeeze, mine = math.cos(math.radians(seed[1])), []
        for j in range(i, len(rows)):
            near = all(abs(a - b) <= 1 for a, b in zip(cell(seed), cell(rows[j])))
            if not taken[j] and near and ((rows[j][2] - seed[2]) * squeeze) ** 2 + (rows[j][1] - seed[1]) ** 2 <= radius * radius:
                taken[j] = True
                mine.append(rows[j])
        out.append((seed[1], seed[2], sum(r[0] for r in mine), len(mine)))
    return sorted(out)


@pytest.mark.parametrize("tile_spots", [100_000, 20])
def test_pins_equal_the_sequential_walk(spark, monkeypatch, tile_spots):
    """Chains of spots of one size, a full cell, both signs, the poles; tiles walked, too full, or not at all."""
    monkeypatch.setattr(places, "TILE_SPOTS", tile_spots)
    monkeypatch.setattr(places, "TILE", 3)
    rng = random.Random(4)
    rows = {(rng.choice([1, 1, 1, 2, 50]), round(rng.uniform(-6, 6), 2), round(rng.uniform(-6, 6), 2)) for _ in range(150)}
    rows |= {(1, 40 + k / 2, 3.0) for k in range(12)} | {(rng.randint(1, 3), 60 + rng.random(), 100 + rng.random()) for _ in range(60)} | {(1, 90.0, 5.0), (2, -90.0, 9.0), (7, 0.0, -179.9)}
    df = spark.createDataFrame([*((n, lat, lon) for n, lat, lon in rows), (None, 1.0, 1.0), (1, None, 1.0), (1, float("nan"), 1.0)], "items long, lat double, lon double")
    found = [(r["seed_lat"], r["seed_lon"], r["items"], r["spots"]) for r in places.zoom_clusters(df, 5).collect()]
    assert sorted(found) == walked_pins(rows, 5)
    assert places.zoom_clusters(df.limit(0), 5).count() == 0


def test_copies_beyond_the_bucket_limit_stay_together(spark):
    one, two, far = [1.0] * 64, [1.0] * 63 + [-1.0], [-1.0] * 64
    rows = [(i, one) for i in range(100)] + [(200, two), (300, far), (301, None), (302, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    pairs, copies = dupes.band_candidates(df), dupes.vector_copies(df)
    assert {tuple(r) for r in pairs.collect()} == {(0, 200)}
    assert {tuple(r) for r in copies.collect()} == {(0, i) for i in range(1, 100)}
    assert {tuple(r) for r in dupes.groups_of(pairs, copies).collect()} == {(i, 0) for i in [*range(100), 200]}


def test_audit_moves_loosens_and_leaves_alone(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    home = [(1000 + 100 * p + i, p, 1000 + 100 * p + i, i * 1000.0, 0, False, at(0)) for p in range(10, 20) for i in range(30)]
    rows = home + [(100 + i, 2, 100 + i, i * 1000.0 + 5e5, 0, False, at(90)) for i in range(30)]
    rows += [
        (500, 10, 500, 1e6, 0, False, at(90)),  # goes to 2
        (501, 11, 501, 2e6, 0, True, at(90)),  # pinned
        (502, 12, 100, 3e6, 0, False, at(90)),  # 2 is in that photo already: goes loose
        (503, 13, 100, 4e6, 1, False, at(90)),  # the same, but confirmed
        (504, 14, 504, 5e6, 0, False, [0.0, 0.0, 1.0]),  # like nobody
        (505, 15, 505, 6e6, 0, False, at(41)),  # 0.755 with its own, 0.656 with 2
        (506, 16, 506, 7e6, 1, False, at(49)),  # 0.656 with its own, 0.755 with 2: confirmed needs 0.15
        (507, 17, 507, 8e6, 0, False, at(50)),  # 0.643 with its own, 0.766 with 2
        (508, 18, 508, 9e6, 0, False, at(90)),  # of two faces of one photo the lesser id goes to 2
        (509, 19, 508, 9e6, 0, False, at(90)),
        (510, 3, 510, 1e7, 0, False, at(90)),  # a person of one face isn't judged
    ]
    rows += [(600 + i, 4, 600 + i, 2e7 + i, 0, False, at(200)) for i in range(30)]  # one burst doesn't vouch for itself
    df = spark.createDataFrame(rows, "id long, person_id long, photo_id long, taken_at double, state int, pinned boolean, emb array<double>")
    found = {r["id"]: r["to"] for r in people.audit(df).collect()}
    assert found == {500: 2, 502: None, 504: None, 507: 2, 508: 2, 509: None, **{600 + i: None for i in range(30)}}


def test_duration_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 200) for _ in range(300)] + [0.0, 0.3, 75.0, 75.3, 74.9]
    df = spark.createDataFrame(list(enumerate(values)), "id long, duration double")
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and abs(a - b) <= max(0.3, 0.004 * min(a, b))}
    rows = dupes.duration_pairs(df).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_due_checks_take_one_at_least(spark):
    df = spark.createDataFrame([("a", 100, None, 0.0, 0.0), ("b", 1, 5.0, 0.0, 0.0), ("c", 1, 1e9, 0.0, 0.0)], "key string, size long, checked_at double, mtime double, ctime double")
    assert [r["key"] for r in upkeep.due_checks(df, 1e9, 10).collect()] == ["a"]
    assert sorted(r["key"] for r in upkeep.due_checks(df, 1e9, 101).collect()) == ["a", "b"]


def test_estimates(spark):
    files = spark.createDataFrame([(i, f"p{i}", 100) for i in range(50)], "id long, path string, bytes long")
    assert upkeep.sample_rows(files).count() == 24
    measured = spark.createDataFrame([(1, 100, 50), (2, 300, 250)], "id long, bytes long, after long")
    assert tuple(upkeep.estimate(files, measured).first()) == (50, 5000, 3750.0)
    assert upkeep.estimate(files, measured.limit(0)).first()["after"] is None


def test_pixels(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0],)], "g array<double>")
    r = df.select(pixels.tone(F.col("g"), [0.0, 1.0, 0.0]), pixels.histogram(F.col("g"), 2), pixels.psnr(F.col("g"), F.col("g")), pixels.luma(F.col("g"), F.col("g"), F.col("g"))).first()
    assert r[0] == [0.0, 1.0, 0.0] and r[1] == [1, 2] and r[2] is None and max(abs(a - b) for a, b in zip(r[3], [0, 0.5, 1])) < 1e-9
    grey = [((i * 7) % 13) / 13 for i in range(256)]
    pair = spark.createDataFrame([(grey, grey, 16), (grey, grey[::-1], 16), (grey, None, 16)], "a array<double>, b array<double>, w int")
    same, other, none = (x[0] for x in pair.select(pixels.ssim("a", "b", "w")).collect())
    assert abs(same - 1) < 1e-9 and other < 0.9 and none is None


def test_every_video_ending_and_screenshot_prefix(spark):
    """The values themselves, spelled here again."""
    endings = "mp4 m4v mov qt mkv webm avi 3gp 3g2 mts m2ts mpg mpeg wmv ogv flv".split()
    df = spark.createDataFrame([(e.upper(),) for e in [*endings, "jpg", "heic", "mp3", ""]] + [(None,)], "ext string")
    assert [r["ext"] for r in df.where(rules.is_video()).collect()] == [e.upper() for e in endings]
    names = ["Screenshot 1.png", "Screen Shot 2.png", "Captura de pantalla 3.png", "ScreenCapture4.png", "screen_shot 5.png", "my screenshot.png", None]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    assert [r["filename"] for r in df.where(rules.is_screenshot()).collect()] == names[:4]


def test_stored_rules_and_iso_dates(spark):
    df = spark.createDataFrame([(1, 0.0, None, 0), (2, 1_600_000_000.0, 4, 2)], "id long, taken_at double, rating int, edit_version int")

    def ids(text, match="all"):
        return [r["id"] for r in df.where(rules.combined(rules.stored(text), match, 2e9)).orderBy("id").collect()]

    assert ids('[{"field": "taken_at", "op": "after", "value": "2020-01-01"}]') == [2]
    assert ids('[{"field": "taken_at", "op": "before", "value": "1970-01-01T00:00:01+00:00"}]') == [1]
    assert ids('[{"field": "rating", "op": "is", "value": -1}]') == []  # a missing rating is no number
    assert ids('[{"field": "rating", "op": "is not", "value": 4}]') == [1]
    assert ids('[{"field": "edited", "op": "is true"}]') == [2] and ids('[{"field": "edited", "op": "is false"}]') == [1]
    assert ids('[{"field": "rating", "op": "greater than", "value": 3}, {"field": "edited", "op": "is false"}]', "any") == [1, 2]
    assert ids("not json") == [1, 2] and ids('[{"field": "unknown", "op": "is", "value": 1}]') == [1, 2]


def test_a_face_is_left_out_only_if_the_next_person_passes_too(spark):
    f = spark.createDataFrame([(1, 10, None, [0.50, 0.47, 0.7270]), (2, 20, None, [0.50, 0.49, 0.7141]), (3, 30, None, [0.60, 0.1, 0.7937])], "id long, photo_id long, person_id long, emb array<double>")
    people_ = spark.createDataFrame([(7, 1, [1.0, 0.0, 0.0]), (8, 1, [0.0, 1.0, 0.0])], "person_id long, faces long, total array<double>")
    found = {r["id"]: r["person_id"] for r in people.assign(f, people_, 0.48, 0.04).collect()}
    assert found == {1: 7, 3: 7}
    there = spark.createDataFrame([(30, 7)], "photo_id long, person_id long")
    assert {r["id"] for r in people.assign(f, people_, 0.48, 0.04, there).collect()} == {1}


def test_health_states_budget_and_rungs(spark):
    cols = "key long, size long, mtime double, ctime double, digest string"
    known = spark.createDataFrame([(k, 5, 1.0, 1.0, "x") for k in range(4)], cols)
    seen = spark.createDataFrame([(0, 5, 1.0, 1.0, "x", "x"), (1, 5, 1.0, 1.0, "y", "y"), (2, 5, 1.0, 1.0, "y", "z"), (3, 5, 1.0, 1.0, "y", "x"), (9, 1, 1.0, 1.0, "q", "q")], cols + ", again string")
    assert {r["key"]: r["state"] for r in upkeep.check_states(known, seen).collect()} == {0: "ok", 1: "damaged", 2: "skipped", 3: "ok", 9: "new"}
    files = spark.createDataFrame([(1, 60, None, 0.0, 0.0), (2, 60, None, 0.0, 0.0), (3, 60, None, 0.0, 0.0), (4, 1, None, 0.0, 9_900.0)], "key long, size long, checked_at double, mtime double, ctime double")
    assert sorted(r["key"] for r in upkeep.due_checks(files, 10_000.0, 100).collect()) == [1, 2]  # the second crosses the budget; the fourth was just written
    tries = spark.createDataFrame([(1, 92, 10, 0.985, 0.955, 0.0022), (1, 90, 9, 0.985, 0.954, 0.0022), (1, 88, 8, 0.985, 0.955, 0.0023)], "id long, rung long, size long, ssim double, worst_block double, chroma_error double")
    assert [tuple(r) for r in upkeep.best_rung(tries).collect()] == [(1, 92, 10)]
    assert [tuple(r) for r in upkeep.best_rung(tries, "balanced").collect()] == [(1, 88, 8)]


def test_natural_order_of_long_numbers(spark):
    names = ["a1700000000002", "a1700000000001", "a007", "a7b", "a10", "10", "b"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r["t"] for r in df.orderBy(text.natural_key("t"), "t").collect()] == ["10", "a007", "a7b", "a10", "a1700000000001", "a1700000000002", "b"]


def test_event_names(spark):
    from datetime import datetime, timezone

    at = lambda y, m, d, h=12: datetime(y, m, d, h, tzinfo=timezone.utc).timestamp()
    cases = [
        (at(2023, 12, 21), at(2023, 12, 24), "Rome", "Christmas 2023"), (at(2023, 12, 23), at(2023, 12, 28), None, "Christmas 2023"), (at(2023, 12, 20), at(2023, 12, 24), "Rome", "Rome · December 2023"),
        (at(2023, 12, 31), at(2024, 1, 2), None, "New Year 2023"), (at(2024, 1, 1), at(2024, 1, 1), "Rome", "New Year 2024"), (at(2023, 11, 14), at(2023, 11, 17), "Rome", "Rome · November 2023"),
        (at(2023, 11, 14), at(2023, 11, 14, 20), "Rome", "Rome · 14 November 2023"), (at(2023, 11, 14), at(2023, 11, 14), "", "Tuesday, 14 November 2023"), (at(2023, 11, 4), at(2023, 11, 7), None, "4–7 November 2023"),
        (at(2023, 11, 29), at(2024, 2, 2), None, "29 November – 2 February 2024"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "a double, b double, place string")
    assert [r[0] for r in df.select(events.event_name(F.col("a"), F.col("b"), F.col("place"))).collect()] == [c[3] for c in cases]


def test_normal_paths_are_those_of_the_system(spark):
    import posixpath

    from medialake.operators import lookups

    paths = ["/a/../b/c.jpg", "./x/y", "//a/b", "///a//b/", "", ".", "..", "../..", "a/..", "/..", "/../../a", "a/../../b", "a/./b/../../..", "/", "//", "a//", "../a/../../b", "//../a"]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    assert [r[0] for r in df.select(lookups.normal_path(F.col("p"))).collect()] == [posixpath.normpath(p) for p in paths] + [None]
    back = df.where("p = './x/y' or p = '//a/b'").select(lookups.normal_path(F.col("p"), True)).collect()
    assert [r[0] for r in back] == ["x\\y", "\\\\a\\b"]
