import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def brute(texts):
    """[(n_bytes, n_removed, n_spans, kept)] per text, by a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        kept = bytes(np.frombuffer(d, "u1")[~gone[:-1]])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, table, rows):
    want = Counter((i, *x) for (i, _), x in zip(table, brute([t for _, t in table])))
    assert Counter(tuple(r) for r in rows) == want


def test_op6(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, table, queries.op6_repeats(spark, SF).collect())


def hard(rng):
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    a, b, long = prose(120), prose(60), prose(9000)
    texts = [a, a + b, b + a, prose(40) + a[:198] + prose(40), prose(40) + a[:199] + prose(9), prose(3) + a[50:250] + prose(40), "z" * 1000, "z" * 430, "ab" * 300, "é" * 150, "é" * 99, long, long[7000:9000] + "!" + long[100:500], a[:200], a[:199], "日本" * 80, b + "日本" * 80 + b]
    for _ in range(30):  # one passage at shifting edges
        texts.append(prose(int(rng.integers(1, 30))) + a[int(rng.integers(0, 60)) : int(rng.integers(230, 400))] + prose(int(rng.integers(1, 30))))
    return texts


@pytest.mark.parametrize("hot", [repeats.HOT_SUFFIXES, 3])
def test_edges_and_hot_passages(spark, docs, hot):
    table = [(i % 40, t) for i, t in enumerate([*hard(np.random.default_rng(3)), None, "", "tiny"])]
    table += [table[3], (None, table[3][1] + "?"), (None, None)]
    assert Counter(tuple(r) for r in queries.repeats_digest(docs(table), hot).collect()) == Counter((i, *x) for (i, _), x in zip(table, brute([t for _, t in table])))


def test_a_hot_line_is_split_until_few_suffixes_share_leading_bytes(spark, docs):
    """A line of 100 dashes, many times in each text, between other lines each time; and a passage in all texts."""
    rng = np.random.default_rng(9)
    line, passage = "-" * 100, " ".join(f"shared{i}" for i in range(60))
    texts = ["\n".join([passage, *(x for _ in range(12) for x in (" ".join(f"w{k}" for k in rng.integers(0, 9, int(rng.integers(5, 30)))), line))]) for _ in range(40)]
    table = list(enumerate(texts))
    assert Counter(tuple(r) for r in queries.repeats_digest(docs(table), 8).collect()) == Counter((i, *x) for (i, _), x in zip(table, brute(texts)))
    near = spark.createDataFrame([(i, t.encode(), repeats.anchors(t.encode())[0].tolist()) for i, t in table], "uid long, data binary, hashes array<long>")
    dealt, sure = repeats.split_hot(repeats.suffixes(near), 8)
    assert sure.count() > 0
    assert dealt.groupBy("lo", "hi", repeats.leading()).count().agg(F.max("count")).first()[0] <= 8


def test_odd_rows(spark, odd):
    table = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, table, queries.repeats_digest(odd).collect())
    assert queries.repeats_digest(odd.limit(0)).count() == 0
    assert repeats.remove_repeats(odd).count() == odd.count()
    clash = odd.withColumn("__digest", F.lit("x")).withColumn("__kept", F.lit("y"))
    assert repeats.remove_repeats(clash).columns == clash.columns
    assert {(r["__digest"], r["__kept"]) for r in repeats.remove_repeats(clash).collect()} == {("x", "y")}
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_removed_text(docs):
    text = " ".join(f"part{i}" for i in range(60))
    rows = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs([(1, "head " + text + " tail"), (2, text), (3, "other"), (4, None)])).collect()}
    assert rows == {1: "head  tail", 2: "", 3: "other", 4: None}


def test_sort_suffixes():
    rng = np.random.default_rng(1)
    rows, group = rng.integers(0, 2, (500, 21)).astype("u1"), rng.integers(0, 4, 500)
    order, common = repeats.sort_suffixes(rows, group)
    keyed = [(group[i], bytes(rows[i])) for i in order]
    assert keyed == sorted(keyed)
    for k in range(1, 500):
        (g, a), (f, b) = keyed[k - 1], keyed[k]
        n = next((i for i in range(21) if a[i] != b[i]), 21)
        assert common[k] == (-1 if g != f else n)
    assert common[0] == -1 and len(repeats.sort_suffixes(rows[:0], group[:0])[0]) == 0


def test_every_window_has_the_anchor_its_bytes_choose(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    text = np.random.default_rng(2).integers(97, 100, 5000).astype("u1").tobytes()
    found = defaultdict(set)
    starts = []
    for a, chunk in repeats.chunks(text):
        for h, place, first, last in zip(*repeats.anchors(chunk, a)):
            for s in range(first, last + 1):
                starts.append(s)
                found[text[s : s + 200]].add((h, place - s))
                assert 0 <= place - s <= repeats.SIDE
    assert starts == list(range(len(text) - 199)) and all(len(x) == 1 for x in found.values())
