from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from medialake.llm import queries, simhash
from medialake.llm.graph import components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """[(doc_id, fp)] -> {(doc_id, fp): component}"""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in rows:
        if d is not None:
            least[find(f)].append(d)
    return {(d, f): min(least[find(f)], default=None) for d, f in rows}


def check(rows, table):
    known = [(d, slow_fingerprint(t)) for d, t in table]
    want = slow_components(known)
    assert Counter(rows) == Counter((d, f"{f:016x}", want[d, f]) for d, f in known)


def test_op5(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check([tuple(r) for r in queries.op5_simhash(spark, SF).collect()], table)


def test_odd_rows(spark, odd):
    table = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows = simhash.near_duplicates(odd).collect()
    check([(r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in rows], table)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_keep_the_components_of_crowded_groups(spark):
    """Chains and clouds of fingerprints around a few centres, larger than a chunk."""
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 2**63, 3):
        f = int(centre)
        for _ in range(700):
            f ^= 1 << int(rng.integers(64))
            f ^= 1 << int(rng.integers(64))
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(f - 2**64 if f >= 2**63 else f,) for _, f in rows]
    found = {r["node"] & (2**64 - 1): r["root"] for r in components(simhash.links(simhash.pivot_table(spark.createDataFrame(signed, "fp long")))).collect()}
    groups = defaultdict(set)
    for i, f in rows:
        groups[found.get(f, ("alone", f))].add(i)
    want = defaultdict(set)
    for (i, _), c in slow_components(rows).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_nothing_that_grows_with_the_texts_is_broadcast(spark, docs):
    rows = docs([(i, f"some words of text {i % 5} and more") for i in range(40)])
    fps = simhash.pivot_table(simhash.fingerprints(rows).groupBy("fp").agg(simhash.F.min("doc_id").alias("first")))
    for df in (simhash.links(fps), simhash.near_duplicates(rows)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_pivot_table_holds_distances(spark):
    rows = simhash.pivot_table(spark.createDataFrame([(5,), (-1,), (-(2**63),)], "fp long")).collect()
    pivots = [xxhash.xxh64_intdigest(str(i), 7) for i in range(simhash.PIVOTS)]
    assert all(list(r["table"]) == [((r["fp"] & (2**64 - 1)) ^ p).bit_count() for p in pivots] for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1c\x85日", max_size=40))
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == slow_fingerprint(text)


def test_too_many_bits(spark):
    with pytest.raises(ValueError):
        simhash.links(simhash.pivot_table(spark.createDataFrame([(1,)], "fp long")), 4)


def shingles(text):
    words = (text or "").lower().split()
    k = max(1, min(5, len(words)))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("stream", [simhash.ROWS_PER_STREAM, 3])
def test_similar_texts_are_copies_and_others_stay(spark, docs, monkeypatch, stream):
    monkeypatch.setattr(simhash, "ROWS_PER_STREAM", stream)
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(4000)]
    table, groups = [], {}
    for g in range(12):
        base = list(rng.choice(vocab, 400))
        for c in range(int(rng.integers(1, 9))):
            words = list(base)
            for at in rng.integers(0, 400, c % 4):
                words[at] = "edited"
            i = len(table) * 3 % 101 + 1000 * (len(table) // 101)
            table.append((i, " ".join(words)))
            groups.setdefault(g, []).append(i)
    half = [(900 + k, " ".join(list(rng.choice(vocab, 200)) + table[0][1].split()[:200])) for k in range(3)]  # half shared: not copies
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(table + half)).collect())
    assert kept == sorted([min(x) for x in groups.values()] + [i for i, _ in half])


def test_keep_one_of_odd_rows(odd):
    rows = simhash.keep_one(odd)
    assert rows.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    a = " ".join(f"w{i}" for i in range(600))
    b = " ".join(f"w{i}" if i % 60 else "x" for i in range(600))
    real = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    (fa, ma), (fb, mb) = simhash.signature(a.encode()), simhash.signature(b.encode())
    assert abs((ma == mb).mean() - real) < 0.12 and (fa ^ fb).bit_count() <= simhash.RADIUS


@pytest.mark.parametrize("rows", [simhash.ROWS_PER_STREAM, 3])
def test_no_link_of_a_family_edited_step_by_step_is_lost(spark, docs, monkeypatch, rows):
    """Each version is near the versions beside it only, so that no single row leads the family."""
    monkeypatch.setattr(simhash, "ROWS_PER_STREAM", rows)
    table = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(400)]
        for v in range(40):
            table.append((g * 100 + v, " ".join(words)))
            for at in range(v * 5, v * 5 + 5):  # the next version: five words in a row
                words[at * 2 % 400] = f"g{g}v{v}x{at}"
    near = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert all(near(x[1], y[1]) > 0.87 for x, y in zip(table, table[1:]) if x[0] + 1 == y[0]) and near(table[0][1], table[39][1]) < 0.5
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(table)).collect()) == [g * 100 for g in range(6)]


def test_a_row_is_linked_to_each_near_row_of_its_band(spark):
    """a is near l, b is near a but not l: b is linked whichever comes first."""
    base = np.arange(simhash.ORDERS, dtype="<u2")
    minima = []
    for changed in (0, 20, 40):
        m = base.copy()
        m[:changed] += 1000
        minima.append(m.tobytes())
    for ids in ((1, 2, 3), (2, 1, 3), (3, 2, 1), (11, 7, 25)):
        df = spark.createDataFrame([(i, 0, m, [7]) for i, m in zip(ids, minima)], "uid long, fp long, minima binary, keys array<long>")
        assert {(r["uid"], r["root"]) for r in simhash.similar_classes(df).collect()} == {(i, min(ids)) for i in ids}


def test_near_copies_are_decided_by_the_shingles_themselves(spark, docs):
    """Pairs a little above and below 0.8: the ones go, the others stay, without exception."""
    rng = np.random.default_rng(11)
    table, want = [], []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(500)]
        other = list(words)
        for at in rng.choice(np.arange(0, 500, 5), 5 + g % 14, replace=False):
            other[at] = f"g{g}x{at}"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        table += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        want += [2 * g] + [2 * g + 1] * (len(a & b) / len(a | b) < 0.8)
    assert 75 < len(want) < 110
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(table)).collect()) == want


def test_repeated_shingles_do_not_discard():
    """The same set of shingles has one fingerprint, however often they are there."""
    words = [f"w{i}" for i in range(300)]
    few, many = (" ".join(words + ["x"] * n).encode() for n in (20, 2000))
    assert simhash.signature(few)[0] == simhash.signature(many)[0]


def test_recall_of_planted_pairs_and_chains(docs):
    """200 pairs of similarity 0.8 to 0.9 and 100 below; 20 chains of which only neighbours are near: none is lost, none too many."""
    rng = np.random.default_rng(11)
    table, near, far, chains = [], [], [], []

    def add(words):
        table.append((len(table), " ".join(words)))
        return len(table) - 1

    def edited(words, changes):
        out = list(words)
        for k, at in enumerate(rng.choice(len(words), changes, replace=False)):
            out[at] = f"new{len(table)}x{k}"
        return out

    def alike(i, j):
        a, b = shingles(table[i][1]), shingles(table[j][1])
        return len(a & b) / len(a | b)

    while len(near) < 200 or len(far) < 100:
        base = [f"d{len(table)}w{k}" for k in range(300)]
        i, j = add(base), add(edited(base, int(rng.integers(3, 12))))
        (near if alike(i, j) >= 0.8 else far).append((i, j))
    for c in range(20):
        words, chain = [f"c{c}w{k}" for k in range(300)], []
        for _ in range(4):
            chain.append(add(words))
            words = edited(words, 4)
        assert all(alike(a, b) >= 0.8 for a, b in zip(chain, chain[1:])) and alike(chain[0], chain[-1]) < 0.8
        chains.append(chain)
    kept = {r["doc_id"] for r in simhash.keep_one(docs(table)).collect()}
    assert {i for i, j in near if j in kept} == set() and all(i in kept for i, _ in near)
    assert all(i in kept and j in kept for i, j in far)
    assert all([x in kept for x in chain] == [True, False, False, False] for chain in chains)
