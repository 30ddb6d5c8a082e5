import hashlib
import re
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from medialake.llm import queries, syncmers

SF = "/root/testdata/sf0.001"


def edits(table):
    """[(doc_id, text)] -> Counter of (doc_id, n, sha256 of the edited text), for different ids."""
    order = sorted(table, key=lambda r: -r[0])
    out = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        out[i, len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest()] += 1
    return out


def test_op1(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op1_syncmers(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == edits(table)
    text = dict(table)
    same = {}
    for r in rows:
        assert same.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in rows if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5
    assert sum(r["near_next"] for r in long) / len(long) < 0.1


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def plain(text):
    """(anchors, places) by the definition, one run at a time, with a public hash library."""
    cut = regex.split(r"\s+|(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}])", text, flags=regex.ASCII | regex.VERSION1)
    words = [h64(w.encode()) for w in cut if w]
    low = lambda x: (x % 2**64).to_bytes(8, "little")
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    if not words:
        return [], []

    def chain(values):
        seed = 42
        for v in values:
            seed = h64(low(v), seed)
        return signed(seed)

    inner = [chain(words[i : i + syncmers.S]) for i in range(len(words) - syncmers.S + 1)]
    runs = range(len(words) - syncmers.K + 1)
    places = [i for i in runs if min(inner[i : i + syncmers.INNER]) in (inner[i], inner[i + syncmers.INNER - 1])]
    if not len(runs):
        places = [0]
    elif not places:
        places = [min(runs, key=lambda i: (chain(words[i : i + syncmers.K]), i))]
    return [chain(words[i : i + syncmers.K]) for i in places], places


def alike(a, b):
    """Shared anchors, and shared pairs of neighbours with their distance, over those of the longer."""
    links = lambda t: {(x, y, q - p) for x, y, p, q in zip(t[0], t[0][1:], t[1], t[1][1:])}
    sets = [(set(a[0]), set(b[0])), (links(a), links(b))]
    most = sum(max(len(x), len(y)) for x, y in sets)
    return sum(len(x & y) for x, y in sets) / most if most else 1.0


def test_every_column_equals_a_plain_loop(spark):
    table = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    own, text = {i: plain(t) for i, t in table}, dict(table)
    hexed = lambda anchors: "".join(f"{x % 2**64:016x}" for x in anchors)
    rows = {r["doc_id"]: r for r in queries.op1_syncmers(spark, SF).collect()}
    for k, (i, t) in enumerate(table):
        after = table[(k + 1) % len(table)][0]
        third = len(t) // 3
        edited = plain(t[: len(t) - third] + text[after][:third])
        r = rows[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(own[i][0]), hexed(edited[0]))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(alike(own[i], edited)), pytest.approx(alike(own[i], own[after])))


def test_position_counts_in_a_match(spark, docs):
    """The same anchors in another order are less alike than in the same order further on."""
    parts = [" ".join(f"p{k}w{w}" for w in range(40)) for k in range(6)]
    rows = {r["doc_id"]: r["near_next"] for r in syncmers.fingerprints(docs([(9, " ".join(parts)), (8, "new words at the start " + " ".join(parts)), (7, "other " * 30), (6, " ".join(parts)), (5, " ".join(reversed(parts)))])).collect()}
    assert rows[9] > 0.9 and rows[6] < rows[9] and rows[8] == 0.0


def test_chosen_runs_are_closed_syncmers(spark):
    """Against the definition, word by word."""
    text = " ".join(f"t{i * i % 13}" for i in range(60))
    df = spark.createDataFrame([(text,)], "text string").withColumn("h", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    df = df.withColumn("s", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1))))
    r = syncmers.with_syncmers(df, "text", "anchors", "places").first()
    want = []
    for i in range(60 - syncmers.K + 1):
        inner = r["s"][i : i + syncmers.INNER]
        if min(inner) in (inner[0], inner[-1]):
            want.append(i)
    assert r["places"] == want and len(r["anchors"]) == len(want)
    other = syncmers.with_syncmers(spark.createDataFrame([("another start here now: " + text,)], "text string"), "text", "anchors", "places").first()
    assert other["anchors"][-len(want) :] == r["anchors"]  # no context but the run's own words


def test_odd_rows(spark, odd, docs):
    rows = syncmers.fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["anchors"] == [] and by[2]["n_chars"] == 0 and by[2]["near_edited"] == 1.0
    assert syncmers.fingerprints(odd.limit(0)).count() == 0
    one = syncmers.fingerprints(docs([(7, "abcdef")])).first()
    assert one["edited"] == "abcdab" and one["near_next"] == 1.0
    table = [(i, t) for i, t in [(3, "é" * 50), (9, None), (5, "日本語のとても長い文章です。" * 3), (1, "x y z")]]
    assert {(r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in syncmers.fingerprints(docs(table)).collect()} == set(edits(table))
    assert len([r for r in syncmers.fingerprints(docs(table)).collect() if r["doc_id"] == 5][0]["anchors"]) > 1


def test_no_python_in_the_plan(spark):
    plan = queries.op1_syncmers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_texts_have_anchors_of_their_own(spark, docs):
    """Texts of 6, 7 and 8 words: none is without an anchor, and different ones aren't alike."""
    table = [(100 * n + k, " ".join(f"a{n}b{k}c{w}" for w in range(n))) for n in (6, 7, 8) for k in range(40)]
    rows = syncmers.fingerprints(docs(table)).collect()
    assert len(rows) == len(table) and all(r["anchors"] and r["near_next"] == 0.0 for r in rows)
    assert all(0 <= p <= 2 for r in rows for p in r["places"])
    twice = syncmers.fingerprints(docs([(1, table[50][1]), (2, table[50][1])])).collect()
    assert all(r["near_next"] == 1.0 for r in twice)
