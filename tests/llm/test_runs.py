import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medialake.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs by a walk over every period, with the smallest period looked for by trial."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            if i > s and len(stretch) >= max(24, 3 * q) and all(stretch[p:] != stretch[:-p] for p in range(1, q)):
                found.append((s, len(stretch), q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n_},{q}\n" for s, n_, q in found)), sha(collapsed))


def test_op11_equals_a_walk_over_all_periods(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()]
    assert Counter(rows) == Counter(digest(*r) for r in table)
    assert sum(r[1] > 0 for r in rows) > 5


def pieces(rng):
    letters, out = rng.choice([1, 2, 3, 30]), []
    for _ in range(rng.randint(0, 6)):
        base = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        out += base * rng.choice([1, 1, 3, rng.randint(1, 14)])
        if rng.random() < 0.2:
            out *= rng.randint(1, 4)
    return out[:300]


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_nested_and_touching_runs(seed, monkeypatch):
    """Runs within runs, runs of runs, the Fibonacci word, one word over and over; texts end where others begin."""
    monkeypatch.setattr(runs, "FIRST_CHUNK", 3)
    rng = random.Random(seed)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    texts = [pieces(rng) for _ in range(300)] + [b, [b"a"] * 24, [b"a"] * 23, [b"a"] * 90, [b"a"] * 90, ([b"a"] * 30 + [b"b"]) * 9, [b"x", b"y", b"z"] * 8, []]
    assert runs.runs_of_texts(texts) == [brute(t) for t in texts]


def test_odd_rows(odd, docs):
    spaced = docs([(1, "a b " * 30), (1, "\x1cq\x0b" * 30), (None, " \t\r\n"), (7, "x " * 500), (8, "x " * 500), (9, "long " + "u v w " * 40_000)])
    for table in (odd, spaced):
        want = Counter(digest(r["doc_id"], r["text"], False) for r in table.where("coalesce(length(text), 0) < 10000").collect())
        assert Counter(tuple(r) for r in queries.runs_digest(table.where("coalesce(length(text), 0) < 10000")).collect()) == want
    assert queries.runs_digest(spaced).where("doc_id = 9").select("n_runs", "start", "length", "period").first()[:] == (1, 1, 120_000, 3)
    assert queries.runs_digest(odd).count() == odd.count()
    assert queries.runs_digest(runs.with_planted_runs(odd.limit(0))).count() == 0
    planted = odd.where("doc_id is null or doc_id <> 5").unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(160)))))
    assert Counter(tuple(r) for r in queries.runs_digest(runs.with_planted_runs(planted)).collect()) == Counter(digest(r["doc_id"], r["text"]) for r in planted.collect())
