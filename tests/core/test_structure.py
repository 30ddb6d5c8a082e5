"""Side files: round trips, damaged documents, cycles of parents, deletions."""

import json
import random


from medialake.sources import structure as st

FOLDERS = "library long, id long, uuid string, name string, parent_id long, created_at double, position int, cover_path string"


def made_again(entries, have):
    """uuid -> parent by the recursive rule: parents first, in the order of the list."""
    by, made, new = {u: p for u, p in entries}, dict.fromkeys(have), {}

    def ensure(u, guard):
        if u in made:
            return u
        if u not in by or u in guard:
            return None
        guard.add(u)
        parent = ensure(by[u], guard) if by[u] else None
        made[u] = new[u] = parent
        return u

    for u, _ in entries:
        ensure(u, set())
    return new


def test_parents_are_those_of_the_recursive_rule(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for lib in range(60):
        names = [f"n{k}" for k in range(rng.randint(1, 9))]
        rng.shuffle(names)
        entries = [(u, rng.choice([None, "lost", "old1", *names, *names])) for u in names]
        have = ["old1"] + [u for u in names if rng.random() < 0.1]
        rows += [(lib, u, p, k, u in have) for k, (u, p) in enumerate(entries)] + [(lib, "old1", None, None, True)]
        want |= {(lib, u): p for u, p in made_again(entries, have).items()}
    df = spark.createDataFrame(rows, "library long, uuid string, parent_uuid string, place int, old boolean")
    assert {(r["library"], r["uuid"]): r["under"] for r in st.tree(df).where("not old").collect()} == want


def test_round_trip_with_damage_and_deletions(spark, tmp_path):
    folders = spark.createDataFrame([(1, 10, "f1", "Trips", None, 5.0, 0, "/a.jpg"), (1, 11, "f2", None, 10, 6.0, 1, None), (2, 10, "f1", "Other", None, 1.0, 0, None)], FOLDERS)
    albums = spark.createDataFrame([(1, "a1", "Sea/side", 1.0, "f2", "/2.jpg"), (1, "a2", "", 1.0, "gone", "/no.jpg"), (1, "a3", "Deleted", 1.0, None, None), (1, "a4", "Kept", 1.0, None, None)], "library long, uuid string, name string, created_at double, folder_uuid string, cover string")
    items = spark.createDataFrame([(1, "a1", "/2.jpg", 2, 9.0), (1, "a1", "/1.jpg", 1, 3.0), (1, "a1", "/no.jpg", 0, None), (1, "a3", "/1.jpg", 0, 7.0), (1, "a4", "/1.jpg", 0, 20.0)], "library long, uuid string, path string, position int, added_at double")
    smart = spark.createDataFrame([(1, "s1", None, None, '[{"field":"rating","op":">","value":3}]', "f1", 2.0)], "library long, uuid string, name string, match_mode string, rules string, folder_uuid string, created_at double")
    removed = spark.createDataFrame([(1, "/3.jpg", 4.0), (1, "/3.jpg", 6.0)], "library long, path string, removed_at double")
    docs = st.folder_documents(folders).union(st.album_documents(albums, items)).union(st.smart_documents(smart)).union(st.removed_documents(removed))
    more = [(1, st.DELETED, json.dumps({"format": "medialake", "albums": {"a3": 8.0, "a4": 8.0}})), (1, "albums/bad.json", "{not json"), (2, "albums/strange.json", '{"format": "x", "uuid": "u"}'), (3, st.FOLDERS, None), (3, "albums/half.json", '{"format": "medialake-album", "uuid": "u3", "pho')]
    docs = docs.union(spark.createDataFrame(more, "library long, name string, content string"))
    st.write_documents(docs, str(tmp_path / "docs"))
    docs = st.read_documents(spark, str(tmp_path / "docs")).select("library", "name", "content")
    listing = spark.createDataFrame([(1, f"/{k}.jpg") for k in range(1, 5)] + [(2, "/3.jpg")], "library long, path string")
    back = st.rebuilt(docs, listing)
    rows = lambda name, *c: sorted(tuple(r) for r in back[name].select(*c).collect())
    assert rows("folders", "library", "uuid", "name", "parent_uuid") == sorted([(1, "f1", "Trips", None), (1, "f2", "Untitled Folder", "f1"), (2, "f1", "Other", None)], key=str)
    assert {(r["uuid"], r["name"], r["folder_uuid"], r["cover"]) for r in back["albums"].collect()} == {("a1", "Sea/side", "f2", "/2.jpg"), ("a2", "a2", None, None), ("a4", "Kept", None, None)}
    assert rows("items", "uuid", "path") == [("a1", "/1.jpg"), ("a1", "/2.jpg"), ("a4", "/1.jpg")]
    assert rows("smart", "uuid", "name", "match_mode", "folder_uuid") == [("s1", "Smart Album", "all", "f1")]
    assert rows("photos", "library", "path") == [(1, "/1.jpg"), (1, "/2.jpg"), (1, "/4.jpg"), (2, "/3.jpg")]
    assert rows("removed", "path", "removed_at") == [("/3.jpg", 6.0)]
    # what only the file knows stays, what was deleted beside it doesn't
    old = json.dumps({"format": "medialake", "folders": [{"uuid": "x"}, {"uuid": "y"}, {"uuid": "f1", "name": "Old"}], "deleted": {"y": 1.0}})
    kept = st.folder_documents(folders.where("library = 1"), spark.createDataFrame([(1, st.FOLDERS, old), (7, st.FOLDERS, old)], "library long, name string, content string"))
    found = {r["library"]: json.loads(r["content"]) for r in kept.collect()}
    assert [f["uuid"] for f in found[1]["folders"]] == ["f1", "f2", "x"] and found[1]["folders"][0]["name"] == "Trips" and found[1]["deleted"] == {"y": 1.0}
    assert [f["uuid"] for f in found[7]["folders"]] == ["x", "f1"]
    empty = st.rebuilt(docs.limit(0), listing.limit(0))
    assert all(df.count() == 0 for df in empty.values())
    assert st.restored_folders(docs.where("library = 1"), spark.createDataFrame([(1, "f1")], "library long, uuid string")).select("uuid", "parent_uuid").collect() == [("f2", "f1")]
