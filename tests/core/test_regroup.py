"""Regrouping of faces against the one-by-one loops that define it."""

import numpy as np
import pytest

from medialake.operators import regroup

FACES = "id long, photo_id long, person_id long, state int, was_person long, yaw double, roll double, emb array<double>"


def unit(v):
    return np.asarray(v, "f8") / np.linalg.norm(v)


def grouped(rows, least):
    """Clusters by joining the most alike two, one at a time. rows: (id, photo, vector)."""
    sums, members, shots = [v.copy() for _, _, v in rows], [[i] for i, _, _ in rows], [{p} for _, p, _ in rows]
    while True:
        best = None
        for a in range(len(sums)):
            for b in range(a + 1, len(sums)):
                link = round(float(sums[a] @ sums[b]) / len(members[a]) / len(members[b]), 9)
                if link >= least and not shots[a] & shots[b] and (best is None or link > best[0]):
                    best = (link, a, b)
        if best is None:
            return {frozenset(m) for m in members}
        _, a, b = best
        sums[a] += sums.pop(b)
        members[a] += members.pop(b)
        shots[a] |= shots.pop(b)


def looped(faces, least_faces, join_at=0.5, min_photos=3):
    """id -> person, or the ids of the new person, one face after the other."""
    rows = [(i, ph, who, state, was, yaw, roll, unit(e)) for i, ph, who, state, was, yaw, roll, e in faces]
    known, anchors, removed, seen = {}, {}, {}, {}
    for i, ph, who, state, was, *_, v in rows:
        if who is not None and state in (0, 1):
            known.setdefault(who, []).append(v)
            seen.setdefault(who, set()).add(ph)
            if state == 1:
                anchors.setdefault(who, []).append(v)
        elif state == 2 and was is not None:
            removed.setdefault(was, []).append(v)
    free = sorted((r for r in rows if r[2] is None and r[3] == 0), key=lambda r: r[0])
    barred = lambda r, who: r[1] in seen[who] or max((float(x @ r[7]) for x in removed.get(who, [])), default=-1) >= 0.8
    out, left, rest = {}, [], []
    big = [w for w, v in known.items() if len(v) >= least_faces]
    for r in free:
        found = sorted(((float(np.mean(sorted((x @ r[7] for x in known[w]), reverse=True)[:5])), -w) for w in big if not barred(r, w)), reverse=True)
        if found and found[0][0] >= 0.58 and found[0][0] - (found[1][0] if len(found) > 1 else 0.3) >= 0.12:
            out[r[0]] = -found[0][1]
            seen[-found[0][1]].add(r[1])
        else:
            left.append(r)
    for r in left:
        found = []
        for w, v in known.items():
            s = float(np.mean(v, axis=0) @ r[7])
            if len(anchors.get(w, [])) >= 3 and np.mean(sorted((x @ r[7] for x in anchors[w]), reverse=True)[:3]) >= 0.5:
                s = max(s, 0.48)
            if not barred(r, w):
                found.append((s, -w))
        found.sort(reverse=True)
        if found and found[0][0] >= 0.48 and not (len(found) > 1 and found[1][0] >= 0.48 and found[0][0] - found[1][0] < 0.04):
            out[r[0]] = -found[0][1]
        else:
            rest.append(r)
    rest = [r for r in rest if abs(r[5]) <= 0.6 and abs(r[6]) <= 45]
    photo = {r[0]: r[1] for r in rest}
    for m in grouped([(r[0], r[1], r[7]) for r in rest], join_at):
        if len({photo[i] for i in m}) >= min_photos:
            out |= {i: ("new", min(m)) for i in m}
    return out


def library(seed, people=6, each=14, loose=150, dim=24):
    """Known people of some faces, loose faces of them and of strangers, a few faces taken out, turned heads, shared photos."""
    rng = np.random.default_rng(seed)
    faces, n = [], 0
    centre = [unit(rng.normal(size=dim)) for _ in range(people + 5)]
    look = lambda c, spread: unit(c + rng.normal(size=dim) * spread / np.sqrt(dim)).tolist()
    for who in range(people):
        for k in range(each if who < 3 else 4):
            faces.append((n, 1000 + n, who, int(k % 3 == 0), None, 0.0, 0.0, look(centre[who], 0.7)))
            n += 1
    for k in range(loose):
        c = centre[int(rng.integers(len(centre)))]
        faces.append((n, int(rng.integers(60)), None, 0, None, float(rng.choice([0.0, 0.3, 0.9], p=[0.6, 0.3, 0.1])), float(rng.choice([0.0, 50.0], p=[0.95, 0.05])), look(c, float(rng.uniform(0.5, 1.3)))))
        n += 1
    for k in range(6):
        like = faces[-1 - k * 7][7]
        faces.append((n, 5000 + k, None, 2, k % people, 0.0, 0.0, like))
        n += 1
    return faces


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 9)])
def test_regroup_equals_the_loop(spark, monkeypatch, seed, block):
    monkeypatch.setattr(regroup, "BLOCK", block)
    faces = library(seed)
    df = spark.createDataFrame([*faces, (9999, 1, None, 0, None, 0.0, 0.0, None)], FACES)
    got = {r["id"]: r["person_id"] if r["how"] != "new" else ("new", r["cluster"]) for r in regroup.regroup(df, least_faces=10).collect()}
    want = looped(faces, 10)
    assert got == want
    assert {type(v) for v in want.values()} == {int, tuple}


def test_ties_equal_faces_and_nothing(spark):
    same = [(i, i % 4, [1.0, 0.0]) for i in range(8)] + [(100 + i, 50 + i, [0.0, 1.0]) for i in range(3)]
    df = spark.createDataFrame(same, "id long, photo_id long, u array<double>")
    found = {}
    for r in regroup.groups(df, 0.5).collect():
        found.setdefault(r["cluster"], []).append((r["id"], r["photo_id"]))
    assert sorted(len(v) for v in found.values()) == [3, 4, 4] and all(len({p for _, p in v}) == len(v) for v in found.values())
    assert regroup.groups(df.limit(0), 0.5).count() == 0
    assert regroup.regroup(spark.createDataFrame([], FACES)).count() == 0


def test_people_merge_as_one_by_one(spark):
    """Best pair first, sums and photos put together, enemies inherited, no more than so many."""
    rng = np.random.default_rng(5)
    centre = [unit(rng.normal(size=12)) for _ in range(4)]
    faces = [(1000 * p + k, int(rng.integers(4000)), p, 0, None, 0.0, 0.0, unit(centre[p % 4] + rng.normal(size=12) * 0.25).tolist()) for p in range(20) for k in range(int(rng.integers(2, 6)))]
    faces += [(50_000, 1, 0, 0, None, 0.0, 0.0, centre[0].tolist()), (50_001, 1, 4, 0, None, 0.0, 0.0, centre[0].tolist())]
    names, apart = {3: "x", 6: "y"}, [(1, 5), (9, 1)]
    for most in (50, 4):
        sums, count, shots, ids = {}, {}, {}, {}
        for _, ph, p, *_, e in faces:
            if p not in names:
                sums[p] = sums.get(p, 0) + unit(e)
                count[p] = count.get(p, 0) + 1
                shots.setdefault(p, set()).add(ph)
                ids[p] = {p}
        live = {p for p in sums if len(shots[p]) >= 3}
        far = {(a, b) for a, b in apart} | {(b, a) for a, b in apart}
        for _ in range(most):
            best = max(((round(float(sums[a] @ sums[b]) / count[a] / count[b], 9), -a, -b) for a in live for b in live if a < b and not shots[a] & shots[b] and not any((x, y) in far for x in ids[a] for y in ids[b])), default=(0,))
            if best[0] < 0.4:
                break
            a, b = -best[1], -best[2]
            sums[a], count[a], shots[a], ids[a] = sums[a] + sums[b], count[a] + count[b], shots[a] | shots[b], ids[a] | ids[b]
            live.remove(b)
        df = spark.createDataFrame(faces, FACES)
        people = spark.createDataFrame([(p, names.get(p)) for p in range(20)], "id long, name string")
        got = {r["person_id"]: r["into"] for r in regroup.merged_people(df, people, spark.createDataFrame(apart, "a long, b long"), 0.4, most).collect()}
        assert got == {x: a for a in live for x in ids[a] if x != a} and len(got) > 2


def test_half_floats(spark):
    from medialake.functions import vectors

    odd = [0.0, -0.0, 6e-8, -6.2e-5, 65504.0, 1e6, float("inf"), float("nan"), 1 / 3]
    rows = spark.createDataFrame([(1, odd), (2, []), (3, None), (4, [None, 1.5])], "id int, v array<float>")
    back = {r["id"]: r["b"] for r in rows.select("id", vectors.from_half(vectors.to_half("v")).alias("b")).collect()}
    np.testing.assert_array_equal(np.array(back[1], "f4"), np.array(odd, "f4").astype("f2").astype("f4"))
    assert np.signbit(back[1][1]) and back[2] == [] and back[3] is None and np.isnan(back[4][0]) and back[4][1] == 1.5
    exact = {r["id"]: r["b"] for r in rows.where("id = 1").select("id", vectors.from_single(vectors.to_single("v")).alias("b")).collect()}
    np.testing.assert_array_equal(np.array(exact[1], "f4"), np.array(odd, "f4"))
    bad = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    assert [r[0] for r in bad.select(vectors.from_half("b")).collect()] == [None, None]


@pytest.mark.parametrize(("piece", "listed"), [(25, 64), (25, 2), (1000, 3)])
def test_groups_of_a_cut_graph_equal_the_loop(spark, monkeypatch, piece, listed):
    """Pieces cut at their median, short lists and few probes leave the same joinings; a group is sent PARTS times, not once for each block."""
    for name, value in {"BLOCK": 5, "PIECE": piece, "LISTED": listed, "PROBES": 12, "PARTS": 3}.items():
        monkeypatch.setattr(regroup, name, value)
    sent = []
    near = regroup._near_groups
    monkeypatch.setattr(regroup, "_near_groups", lambda live, count, least: sent.append(count) or near(live, count, least))
    rng = np.random.default_rng(piece + listed)
    rows = [(i, int(rng.integers(40)), unit(rng.normal(size=5) + 1.5 * (i % 4 == 0))) for i in range(110)]
    df = spark.createDataFrame([(i, p, v.tolist()) for i, p, v in rows], "id long, photo_id long, u array<double>")
    found = {}
    for r in regroup.groups(df, 0.4).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(v) for v in found.values()} == grouped(rows, 0.4)
    assert sent[0] == 110 and all(a >= b for a, b in zip(sent, sent[1:]))


def test_the_first_joinings_need_not_wait_for_all(spark, monkeypatch):
    for name, value in {"PIECE": 60, "PROBES": 40}.items():
        monkeypatch.setattr(regroup, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, unit(rng.normal(size=8)).tolist(), 1, [i], [i], []) for i in range(150)]
    live = spark.createDataFrame(rows, "g long, total array<double>, n long, ids array<long>, photos array<long>, apart array<long>")
    rounds, near = [], regroup._near_groups
    monkeypatch.setattr(regroup, "_near_groups", lambda *a: rounds.append(a) or near(*a))
    some = regroup.joined(live, 0.1, 5)[1].orderBy(regroup.F.desc("link")).limit(5).collect()
    few = len(rounds)
    every = regroup.joined(live, 0.1)[1].orderBy(regroup.F.desc("link")).limit(5).collect()
    assert some == every and few < len(rounds) - few


def test_a_pair_of_blocks_goes_to_python_alone(spark):
    import pandas as pd

    from medialake.operators import people

    blocks, n = people._blocks(spark.range(40).coalesce(1), 5, "id")

    def compare(batches):
        for batch in batches:
            yield pd.DataFrame({"pairs": [len(batch)], "rows": [sum(map(len, batch["mine"]))]})

    met = people._meet(blocks, blocks, n, compare, "pairs long, rows long").collect()
    held = blocks.count()
    assert len(met) == held * held and {r["pairs"] for r in met} == {1} and sum(r["rows"] for r in met) == 40 * held


@pytest.mark.parametrize("small", [False, True])
def test_all_faces_of_a_person_are_compared(spark, monkeypatch, small):
    from medialake.operators import people

    if small:
        for name, value in {"PART": 90, "PERSON": 200, "STRIP": 64, "WIDE": 50, "GIVEN": 3000}.items():
            monkeypatch.setattr(people, name, value)
    rng = np.random.default_rng(3)
    rows = [(k, 1 if k < 1700 else 2 + k % 3 if k % 4 else None, float(k * 200), rng.normal(size=4).tolist()) for k in range(1800)]
    df = spark.createDataFrame(rows, "id long, person_id long, taken_at double, emb array<double>")
    u, who, at = np.array([unit(r[3]) for r in rows]), np.array([r[1] or 0 for r in rows]), np.array([r[2] for r in rows])
    for moment, far in ((None, ~np.eye(len(rows), dtype=bool)), (900.0, abs(at[:, None] - at) > 900)):
        like = np.where(far, u @ u.T, -9.0)
        want = {(i, p): np.mean(-np.sort(-like[i, who == p])[:5]) for i in range(len(rows)) for p in (1, 2, 3, 4)}
        got = {(r["id"], r["person_id"]): r["mean"] for r in people.knn_means(df, moment=moment).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_the_well_known_take_what_any_of_their_faces_says(spark):
    # five faces of the person are 0.6 like each loose one, and no other is: with one of the five left out, the likeness is not enough
    rng = np.random.default_rng(4)
    spots = [unit(rng.normal(size=64)) for _ in range(320)]
    near = lambda v, x: (0.6 * v + 0.8 * unit(x - (x @ v) * v)).tolist()
    rows = [(5 * k + j, 10_000 + 5 * k + j, 7, 0, None, 0.0, 0.0, near(spots[k], rng.normal(size=64))) for k in range(320) for j in range(5)]
    rows += [(50_000 + k, k, None, 0, None, 0.0, 0.0, spots[k].tolist()) for k in range(320)]
    got = {(r["id"], r["person_id"], r["how"]) for r in regroup.regroup(spark.createDataFrame(rows, FACES)).collect()}
    assert got == {(50_000 + k, 7, "known") for k in range(320)}
