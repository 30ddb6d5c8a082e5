"""Pulling from other computers: merging in any order, apply, what is read, paths of other computers."""

import itertools
import json
import random

from medialake.operators import sync
from medialake.sources import structure as st

DOC = "library long, source string, name string, content string"
FILES = "library long, source string, name string, size long, mtime double"


def folded(copies, kind):
    """Copies merged one after another: entries by key and deletions, two at a time."""
    best, gone = {}, {}
    for c in copies:
        for k, e in c[kind].items():
            if k not in best or e["modified_at"] > best[k]["modified_at"]:
                best[k] = e
        for k, t in c["gone"].items():
            gone[k] = max(gone.get(k, 0), t)
        best = {k: e for k, e in best.items() if gone.get(k, -1) < e["modified_at"]}
        gone = {k: t for k, t in gone.items() if k not in best}
    return best, gone


def test_lists_are_those_of_merging_one_after_another_in_any_order(spark):
    rng, docs, want = random.Random(3), [], {}
    for lib in range(40):
        times = iter(rng.sample(range(1, 90), 45))  # no ties, so that every order must agree
        copies = []
        for s in range(3):
            keys = [k for k in "abcdefg" if rng.random() < 0.7]
            copies.append({"e": {k: {"uuid": k, "name": f"{k}{s}", "modified_at": float(next(times))} for k in keys}, "gone": {k: float(next(times)) for k in "abcdefgh" if k not in keys and rng.random() < 0.6}})
        ways = {json.dumps(folded(p, "e"), sort_keys=True) for p in itertools.permutations(copies)}
        assert len(ways) == 1
        want[lib] = json.loads(ways.pop())
        for s, c in zip(("", "b", "c"), copies):
            docs.append((lib, s, st.FOLDERS, json.dumps({"format": st.STRUCTURE, "folders": list(c["e"].values()), "deleted": c["gone"]})))
    kept, gone = sync.merged_list(spark.createDataFrame(docs, DOC).repartition(5), "folders")
    got = {(r["library"], r["uuid"]): (r["name"], r["modified_at"]) for r in kept.collect()}
    assert got == {(lib, k): (e["name"], e["modified_at"]) for lib, (best, _) in want.items() for k, e in best.items()}
    assert {(r["library"], r["uuid"]): r["gone_at"] for r in gone.collect()} == {(lib, k): t for lib, (_, out) in want.items() for k, t in out.items()}


def test_ties_damage_and_album_deletions(spark):
    album = lambda source, name, at, photos, added=None, removed=None, uuid="a": (1, source, f"albums/{name}.json", json.dumps({"format": st.ALBUM, "uuid": uuid, "name": name, "modified_at": at, "photos": photos, "added": added or {}, "removed": removed or {}}))
    docs = [
        album("c", "theirs", 5.0, ["/2", "/3", None], {"/3": 4.0}), album("", "mine", 5.0, ["/1", "/2"], {"/1": 2.0}, {"/3": 4.5}), album("b", "other", 5.0, ["/1"], {"/1": 9.0}, {"/2": 0.0}),
        album("", "gone", 1.0, ["/1"], {"/1": 3.0}, uuid="g"), album("b", "back", 1.0, ["/1"], {"/1": 3.5}, uuid="h"), (1, "b", "albums/broken.json", "{"), (1, "b", "albums/foreign.json", '{"format":"x","uuid":"z"}'), (1, "b", "albums/null.json", None),
        (1, "b", st.DELETED, json.dumps({"format": st.STRUCTURE, "albums": {"g": 3.0, "h": 3.0, "lost": 1.0}})),
    ]
    kept, items, gone = sync.merged_albums(spark.createDataFrame(docs, DOC))
    assert {(r["uuid"], r["name"]) for r in kept.collect()} == {("a", "mine"), ("h", "back")}
    assert {(r["uuid"], r["path"]): r["stays"] for r in items.collect()} == {("a", "/1"): True, ("a", "/2"): True, ("a", "/3"): False, ("h", "/1"): True}
    assert {r["uuid"] for r in gone.collect()} == {"g", "lost"}
    empty = spark.createDataFrame([], DOC)
    assert all(df.isEmpty() for df in (*sync.merged_albums(empty), *sync.merged_list(empty, "marks"), sync.merged_removed(empty)))


def _index(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, "library long, " + schema)
    return {
        "photos": make([(1, f"/{i}", 1, 2, 0, None, "t", None, None, i) for i in range(1, 6)], f"path string, {sync.MARK_FIELDS}, extra long"),
        "folders": make([(1, "top", "Top", None, None), (1, "in", "In", "top", None), (1, "deep", "Deep", "in", None), (1, "x", "X", None, None), (1, "y", "Y", None, None)], "uuid string, name string, parent_uuid string, cover string"),
        "smart": make([(1, "s1", "S", "all", "[]", "deep"), (1, "s2", "S2", "any", "[1]", None)], "uuid string, name string, match_mode string, rules string, folder_uuid string"),
        "albums": make([(1, "stays", "A", "deep", "/1"), (1, "lost", "B", "deep", None), (1, "out", "C", None, None)], "uuid string, name string, folder_uuid string, cover string"),
        "items": make([(1, "stays", "/1"), (1, "stays", "/2"), (1, "stays", "/5"), (1, "lost", "/1"), (1, "out", "/1")], "uuid string, path string"),
        "removed": make([(1, "/4", 1.0)], "path string, gone_at double"),
    }


def test_apply_deletes_folders_last_and_cuts_cycles(spark):
    doc = lambda source, name, **body: (1, source, name, json.dumps({"format": st.STRUCTURE, **body}))
    f = lambda u, parent, at, name="": {"uuid": u, "name": name, "parent_uuid": parent, "modified_at": at}
    docs = [
        doc("b", st.FOLDERS, folders=[f("x", "y", 2.0, "X2"), f("new", "in", 1.0), f("far", "nowhere", 1.0)], deleted={"top": 9.0}), doc("c", st.FOLDERS, folders=[f("y", "x", 3.0)]),
        doc("b", st.SMART, smart_albums=[{"uuid": "s2", "name": "", "match_mode": "all", "rules": "[2]", "modified_at": 1.0}], deleted={}),
        doc("b", st.DELETED, albums={"out": 5.0}), doc("c", st.REMOVED, photos={"/5": 3.0, "/4": 2.0}),
        doc("c", sync.MARKS, photos={"/1": {"favorite": 0, "rating": 5, "modified_at": 2.0}, "/9": {"rating": 1, "modified_at": 1.0}}, cleared={"/2": 4.0}),
        (1, "b", "albums/s.json", json.dumps({"format": st.ALBUM, "uuid": "stays", "name": "A2", "folder_uuid": "x", "cover": "/9", "modified_at": 4.0, "photos": ["/1", "/3", "/9"], "added": {"/1": 1.0, "/3": 2.0}, "removed": {"/2": 3.0}})),
    ]
    out = sync.applied(_index(spark), spark.createDataFrame(docs, DOC))
    assert {(r["uuid"], r["name"], r["parent_uuid"]) for r in out["folders"].collect()} == {("x", "X2", "y"), ("y", "Y", None), ("far", "Untitled Folder", None)}
    assert {(r["uuid"], r["name"], r["folder_uuid"], r["cover"]) for r in out["albums"].collect()} == {("stays", "A2", "x", "/1")}
    assert {tuple(r) for r in out["items"].select("uuid", "path").collect()} == {("stays", "/1"), ("stays", "/3")}
    assert {(r["uuid"], r["name"], r["match_mode"], r["rules"]) for r in out["smart"].collect()} == {("s2", "S2", "all", "[2]")}
    assert {(r["path"], r["favorite"], r["rating"], r["title"], r["extra"]) for r in out["photos"].collect()} == {("/1", 0, 5, None, 1), ("/2", 0, 0, None, 2), ("/3", 1, 2, "t", 3), ("/4", 1, 2, "t", 4)}
    assert {tuple(r) for r in out["removed"].collect()} == {(1, "/4", 1.0), (1, "/5", 3.0)}


def test_only_changed_files_are_read_and_a_second_pull_changes_nothing(spark):
    mark = lambda rating: json.dumps({"format": st.STRUCTURE, "photos": {"/1": {"rating": rating, "modified_at": float(rating)}}})
    docs = spark.createDataFrame([(1, "b", sync.MARKS, mark(4)), (1, "c", sync.MARKS, mark(5)), (1, "d", sync.MARKS, "{")], DOC)
    listing = spark.createDataFrame([(1, s, sync.MARKS, 10, 1.0) for s in "bcde"], FILES)
    seen = spark.createDataFrame([(1, "c", sync.MARKS, 10, 1.0), (1, "b", sync.MARKS, 9, 1.0)], FILES)
    out, after = sync.pulled(_index(spark), docs, listing, seen)
    assert out["photos"].where("path = '/1'").first()["rating"] == 4  # c was read before
    assert sorted(r["source"] for r in after.collect()) == ["b", "c", "d"]  # e has no document yet: looked at again
    assert [r["source"] for r in sync.changed(listing, after).collect()] == ["e"]
    again, _ = sync.pulled(out, docs, listing, after)
    for name, df in again.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, out[name].select(*df.columns).collect())), name


def test_edits_and_originals(spark):
    listing = spark.createDataFrame([(1, "b", f"edits/{k}", 1, 10.0) for k in "abcd"] + [(1, s, f"originals/{n}", 1, 1.0) for s in "cb" for n in ("v.MOV", "p.jpg", "here.jpg", "off.jpg", "new.mp4")], FILES)
    local = spark.createDataFrame([(1, "edits/a", 2, 10.0), (1, "edits/b", 2, 9.9), (1, "edits/c", 2, 50.0), (1, "originals/here.jpg", 1, 1.0)], "library long, name string, size long, mtime double")
    sent = spark.createDataFrame([(1, "edits/c", 2, 49.5)], local.schema)
    assert {r["name"]: r["take"] for r in sync.edits_to_take(listing, listing.limit(0), local, sent).collect()} == {"edits/a": False, "edits/b": True, "edits/c": True, "edits/d": True}
    name = lambda n: spark.createDataFrame([(1, n)], "library long, name string")
    got = sync.originals_to_fetch(listing, local, name("originals/off.jpg"), name("originals/new.mp4"))
    assert {tuple(r) for r in got.collect()} == {(1, "b", "originals/v.MOV", 1), (1, "b", "originals/p.jpg", 0)}


def test_paths_of_another_computer(spark):
    body = {"photos": ["/home/an $a/Lib/1.jpg", "/home/an $a/Library/2.jpg", "/home/an $a/Lib"], "title": 'say "/home/an $a/Lib/x'}
    docs = spark.createDataFrame([(1, "b", "n", json.dumps(body)), (1, "c", "n", json.dumps(body)), (1, "", "n", None)], DOC)
    roots = spark.createDataFrame([(1, "", "/Users/a$1\\b"), (1, "b", "/home/an $a/Lib")], "library long, source string, root string")
    got = {r["source"]: r["content"] for r in sync.adopted(docs, roots).collect()}
    assert json.loads(got["b"]) == {**body, "photos": ["/Users/a$1\\b/1.jpg", "/home/an $a/Library/2.jpg", "/Users/a$1\\b"]}
    assert json.loads(got["c"]) == body and got[""] is None
