"""Operators whose work must grow with the rows: equal to plain loops, on copies, ties and edges."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from medialake import queries as media
from medialake.functions import text
from medialake.operators import components, dupes, grammar, lookups, places, sets
from medialake.plans import upkeep


def test_duration_links_equal_all_pairs(spark):
    rng = random.Random(5)
    values = [rng.choice((rng.uniform(0, 4), rng.uniform(70, 90), k / 10, k * 0.3, 75 + k * 0.3, 100 * 1.004 ** (k % 9))) for k in range(250)]
    values += values[:40] + [0.0, 0.3, 75.0, 75.3, 500.0, 500.0, 900.0, None, -1.0, float("nan"), float("inf")]
    rows = list(enumerate(values))
    near = {i: {j for j, b in rows if b is not None and 0 <= b < 1e9 and abs(a - b) <= max(0.3, 0.004 * min(a, b))} for i, a in rows if a is not None and 0 <= a < 1e9}
    roots = {}
    for i in near:
        if i not in roots:
            seen, todo = {i}, [i]
            while todo:
                todo += (new := near[todo.pop()] - seen)
                seen |= new
            roots |= {j: min(seen) for j in seen}
    got = {r["id"]: tuple(r)[1:] for r in dupes.duration_links(spark.createDataFrame(rows, "id long, duration double")).collect()}
    assert got == {i: (roots[i], len(near[i]) - 1, min(values[j] for j in near[i]), max(values[j] for j in near[i])) if i in near else (i, 0, None, None) for i, _ in rows}


def test_duration_query_has_a_row_for_each_part(spark):
    d = "/root/testdata/sf0.001"
    assert media.QUERIES["duration_band_pairs"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").where(F.col("p_partkey").isNotNull()).count()


def test_event_of_photo_equals_a_loop(spark):
    rng = random.Random(7)
    events = [(k, float(s), float(s + rng.choice((0, 1, 50, 30_000, 200_000, -5)))) for k, s in ((k, rng.randrange(-90_000, 300_000, 500)) for k in range(300))]
    events += [(1000 + k, s, e) for k, (_, s, e) in enumerate(events[:50])] + [(2000, None, 5.0), (2001, 5.0, None)]
    photos = [(k, rng.choice((None, float(rng.randrange(-95_000, 330_000, 250)), rng.uniform(0, 90_000)))) for k in range(500)]
    in_ = {i: [(s, k) for k, s, e in events if s is not None and e is not None and s <= t <= e] for i, t in photos if t is not None}
    want = sorted((i, max(found)[1]) for i, found in in_.items() if found)
    got = lookups.event_of_photo(spark.createDataFrame(photos, "id long, taken_at double"), spark.createDataFrame(events, "id long, start_at double, end_at double"))
    assert sorted(map(tuple, got.collect())) == want


def test_counted_searches_equal_the_photos_found(spark, monkeypatch):
    for name, value in {"LEAST_BLOCK": 8, "LARGEST_BLOCK": 40, "FORMS_AT_ONCE": 7}.items():
        monkeypatch.setattr(grammar, name, value)
    rng = random.Random(11)
    photos = spark.range(90).where("id % 7 > 0")
    keys = spark.createDataFrame([(p, f"k{rng.randrange(12)}") for p in range(90) if p % 7 for _ in range(4)] * 2, "photo long, key string")
    rows = [(i, rng.random() < 0.3, sorted({f"k{rng.randrange(14)}" for _ in range(rng.randint(1, 3))})) for i in range(60) for _ in range(rng.randint(1, 3))]
    terms = spark.createDataFrame(rows, "id long, negative boolean, keys array<string>")
    want = {r["form"]: r["n"] for r in grammar.matches(terms, keys, photos).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert {r["form"]: r["photos"] for r in grammar.counted(terms, keys, photos).collect()} == want


def test_searches_of_one_text_are_read_once(spark, monkeypatch):
    words = grammar.fixed_words(spark, date(1996, 1, 3))
    one = [tuple(r)[1:] for r in grammar.read(spark.createDataFrame([(1, "videos 1995 -clip")], "id long, text string"), words).collect()]
    read, seen = grammar._read, []
    monkeypatch.setattr(grammar, "_read", lambda searches, vocabulary: (seen.append(searches.count()), read(searches, vocabulary))[1])
    got = grammar.read(spark.createDataFrame([(k, "videos 1995 -clip" if k % 5 else None) for k in range(40)], "id long, text string"), words).collect()
    assert seen == [1] and sorted(map(str, got)) == sorted(map(str, (type(got[0])(**dict(zip(got[0].asDict(), (k, *t)))) for k in range(40) if k % 5 for t in one)))


def test_alike_videos_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sets, "CELL", 3)
    rng = random.Random(13)
    base = [[[rng.random() for _ in range(16)] for _ in range(2)] for _ in range(6)]
    rows = []
    for k in range(60):
        b = base[rng.randrange(6)]
        noise = rng.choice((0, 0, 0.02, 0.1, 0.16))
        moment = lambda m: [[min(1.0, max(0.0, b[m % 2][(j * (3 if m == 2 else 1)) % 16] + rng.uniform(-noise, noise))) for j in range(16)] for _ in range(rng.randint(1, 2))]  # noqa: B023, E731
        rows.append((k, rng.choice((5.0, 5.2, 5.4, 9.0)), rng.random() < 0.7, rng.choice((None, None, 1, 2)), rng.choice((True, False, None)), [moment(m) for m in range(rng.choice((0, 3, 3, 3, 2)))]))
    df = spark.createDataFrame(rows, "id long, duration double, is_new boolean, root long, sound boolean, shots array<array<array<double>>>")
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and abs(x[1] - y[1]) <= 0.3 and (x[2] or y[2]) and not (x[3] is not None and x[3] == y[3])]
    scored = sets.moments_alike(spark.createDataFrame(pairs, "a long, b long"), df).collect()
    want = sorted((r["a"], r["b"]) for r in scored if min(r["scores"]) >= sets.VIDEO_MIN and sum(r["scores"]) / len(r["scores"]) >= sets.VIDEO_MEAN)
    assert len(want) > 10 and sorted(map(tuple, sets.alike_videos(df).collect())) == want


def test_videos_of_one_length_meet_in_few_cells(spark, monkeypatch):
    n = 2600
    df = spark.range(n).selectExpr("id", "5D AS duration", "true AS is_new", "CAST(NULL AS BIGINT) AS root", "true AS sound", "array(array(array(0.5D))) AS shots")
    monkeypatch.setattr(sets, "_same_videos", lambda a, b: [(len(a), len(b))])
    assert sum(r["a"] + r["b"] for r in sets.alike_videos(df).collect()) < 10 * n


def test_videos_are_compared_strip_by_strip(spark, monkeypatch):
    for name, value in {"CELL": 10, "ROWS": 3, "COLUMNS": 4}.items():
        monkeypatch.setattr(sets, name, value)
    rng = random.Random(23)
    base = [[[rng.random() for _ in range(9)] for _ in range(4)] for _ in range(8)]
    rows = [(k, 5.0, True, None, True, [[[x + rng.uniform(0, 0.02) for x in m]] for m in base[k % 8]]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, duration double, is_new boolean, root long, sound boolean, shots array<array<array<double>>>")
    assert sorted(map(tuple, sets.alike_videos(df).collect())) == [(i, j) for i in range(50) for j in range(i + 1, 50) if i % 8 == j % 8]


def test_samples_of_equal_paths_go_by_id(spark):
    files = spark.createDataFrame([(k * 37 % 100, f"p{k * 37 % 100 // 50}") for k in range(100)], "id long, path string").repartition(7)
    assert sorted(r["id"] for r in upkeep.sample_rows(files, 10).collect()) == list(range(0, 100, 10))


def test_names_near_equal_all_pairs(spark):
    rng = random.Random(17)
    names = ["", "a", "ab", "ba", "abc", "acb", "abcd", "añb", "aab", "b", "bb", None]
    rows = [(k, rng.choice(("x", "y", None)), rng.choice(names)) for k in range(120)]
    first = {}
    for k, g, n in rows:
        if g is not None and n is not None:
            first.setdefault((g, n), k)

    def near(a, b):
        cuts = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
        return a in cuts(b) or b in cuts(a) or len(a) == len(b) and sum(p != q for p, q in zip(a, b)) <= 1

    want = {(first[g, n], k, True) for k, g, n in rows if (g, n) in first and first[g, n] < k} | {(i, j, False) for (g, n), i in first.items() for (h, m), j in first.items() if g == h and i < j and near(n, m)}
    got = dupes.names_near(spark.createDataFrame(rows, "id long, g string, name string"), ["g"], "name").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_name_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dupes, "TOGETHER", 3)
    rng = random.Random(19)
    rows = [(k * 7 % 151, rng.choice(("x", "y", None)), rng.choice(["", "a", "ab", "ba", "abc", "acb", "b", None])) for k in range(150)]
    near = lambda s, t: len(s) <= len(t) and (any(t[:i] + t[i + 1 :] == s for i in range(len(t))) or len(s) == len(t) and sum(p != q for p, q in zip(s, t)) <= 1)
    want = sorted((a, b) for a, g, s in rows for b, h, t in rows if a < b and g == h and None not in (g, s, t) and (near(s, t) or near(t, s)))
    got = dupes.name_pairs(spark.createDataFrame(rows, "id long, g string, name string"), ["g"], "name").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 200


def test_duration_query_has_every_pair(spark):
    d = "/root/testdata/sf0.001"
    parts = [(r[0], r[1] / 7) for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice").collect()]
    want = {(i, j) for i, a in parts for j, b in parts if i < j and abs(a - b) <= max(0.3, min(a, b) * 0.004)}
    got = [(r["id"], int(j)) for r in media.QUERIES["duration_band_pairs"](spark, d).collect() for j in r["linked"].split(",") if j]
    assert len(got) == len(want) and set(got) == want


def test_points_and_towns_of_one_place_meet_once(spark, monkeypatch):
    points = spark.createDataFrame([(k, float(k % 3), 10.0 if k % 4 else None) for k in range(60)], "id long, lat double, lon double")
    towns = spark.createDataFrame([(k, float(k % 2), 10.2, (k * 7 % 5) * 100_000) for k in range(30)], "id long, lat double, lon double, population long")
    near, met = places.near, []
    monkeypatch.setattr(places, "near", lambda *a: (met.append(near(*a).count()), near(*a))[1])
    nearest = {r["id"]: r["town_id"] for r in places.nearest(points, towns, 200.0).collect()}
    assert nearest == {k: 0 if k % 3 == 0 else 1 for k in range(60) if k % 4}
    largest = {r["id"]: r["town_id"] for r in places.largest(points, towns, 60.0).collect()}
    assert largest == {k: 2 if k % 3 == 0 else 7 for k in range(60) if k % 4 and k % 3 < 2}
    assert max(met) <= 6


def test_merged_answers_equal_a_loop(spark):
    rng = random.Random(19)
    rows = [(k, rng.choice(("Rome", "ROME", "Oslo", None)), rng.choice(("d", "D", "e", "f", None)), rng.choice(("", "", None, "park", "bar")), rng.choice((0.0, 0.003, 0.0041, -0.001, 5.0, None)), rng.choice((0.0, 0.004, -0.003))) for k in range(40)]
    fold = lambda s: None if s is None else s.lower()

    def same(a, b):
        close = a[4] is not None and b[4] is not None and abs(a[4] - b[4]) < 0.004 and abs(a[5] - b[5]) < 0.004
        return a[1] is not None and fold(a[1]) == fold(b[1]) and (close or fold(a[2] or "") == fold(b[2] or ""))

    want = []
    for a in rows:
        if not any(b[0] < a[0] and same(a, b) for b in rows):
            want.append((a[0], a[3] or next((b[3] for b in rows if b[0] > a[0] and same(a, b) and b[3]), None)))
    got = places.merged_answers(spark.createDataFrame(rows, "id long, title string, detail string, kind string, lat double, lon double")).collect()
    assert sorted(map(tuple, got)) == want


def test_long_lists_of_keywords(spark):
    words = [f"{'Ab'[k % 2]}{k * 7919 % 1500} x" for k in range(6000)]
    seen = {}
    for w in words:
        seen.setdefault(w.lower(), w)
    df = spark.createDataFrame([(" ; ".join(words) + ",,",), (None,), ("b;B, a ;A",)], "t string")
    assert [r[0] for r in df.select(text.merge_keywords(F.col("t"), F.lit(""))).collect()] == ["; ".join(seen.values()), "", "b; a"]


def test_stray_partials_equal_a_loop(spark):
    rng = random.Random(23)
    names = ["a.jpg", "a.jpg.part", ".a.smaller.mp4.part", "a-2.mov", "a", ".a.b.smaller.mp4.part", "a.b-1.mp4", ".smaller.smaller.mp4.part", ".part", "b.part", "b", "..smaller.mp4.part", "", ".c.smaller.mp4.part", "c", "cd.mp4"]
    rows = [(f"{rng.choice(('Originals', 'Other'))}/{k % 9}", rng.choice(names), rng.choice((None, 0.0, 1e9))) for k in range(300)]
    want = set()
    for folder, name, mtime in rows:
        if name.endswith(".part") and folder.startswith("Originals/") and 1e9 - (mtime or 0.0) >= 86_400:
            made = re.match(upkeep.HALF_MADE, name)
            of = made[1] if made else name[:-5]
            fits = lambda b: b == of or made and (b.startswith(of + ".") or b.startswith(of + "-"))  # noqa: B023, E731
            if any(f == folder and fits(b) and b != name for f, b, _ in rows):
                want.add((folder, name))
    got = upkeep.stray_partials(spark.createDataFrame(rows, "folder string, name string, mtime double"), 1e9).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_picture_candidates_equal_all_pairs(spark):
    rng = random.Random(29)
    rows = []
    for k in range(150):
        own = [rng.choice((0.0, 1.0)) for _ in range(4)]
        bands = [f"{b}:{rng.randrange(12)}" for b in range(3)] + ["3:full" if k < 70 else f"3:{k % 5}"]
        rows.append((k, rng.random() < 0.5, rng.choice((1.0, 3.0, 9.0)), [x + rng.choice((0.0, 0.05, 0.1)) for x in own], bands))
    size = {}
    for r in rows:
        for b in r[4]:
            size[b] = size.get(b, 0) + 1
    small = {b for b, n in size.items() if 2 <= n <= sets.BUCKET_MAX}
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and (x[1] or y[1]) and min(x[2], y[2]) >= sets.FLAT and small & set(x[4]) & set(y[4]):
                total = 0.0
                for p, q in zip(x[3], y[3]):
                    total += abs(p - q)
                if total / 4 < sets.LOOK_PREFILTER:
                    want.add((x[0], y[0]))
    df = spark.createDataFrame(rows, "id long, is_new boolean, sd double, z array<double>, bands array<string>")
    candidates = sets.picture_candidates(df)
    got = [tuple(r) for r in candidates.collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_long_chains_settle_in_few_rounds(spark):
    # the least is at one end and the way to it goes up: labels that only go from neighbour to neighbour take a round for each link
    chain = [1000, *range(1300, 1000, -1)]
    rows = [*zip(chain, chain[1:]), (5, 5), (8, 9), (9, 8), (None, 3)]
    got = components.components(spark.createDataFrame(rows, "a long, b long"), rounds=20).collect()
    assert sorted(map(tuple, got)) == [(8, 8), (9, 8), *((i, 1000) for i in range(1000, 1301))]
