import datetime as dt

from pyspark.sql import functions as F

from medialake.operators import events
from medialake.sources import files
from medialake.streaming import sessions as stream


def test_listing_and_fingerprints(spark, tmp_path):
    for name, data in {"a/x.JPG": b"1", "a/y.jpg": b"1", ".hidden/z.jpg": b"2", "node_modules/n.png": b"3", "a/t.txt": b"4"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = files.listing(spark, str(tmp_path)).collect()
    assert sorted((r["filename"], r["ext"], r["bytes"]) for r in rows) == [("x.JPG", "jpg", 1), ("y.jpg", "jpg", 1)]
    listed = files.listing(spark, str(tmp_path), ("jpg", "txt"))
    for hashed, column in ((files.fingerprints(listed), "fingerprint"), (files.digests(listed), "digest")):
        prints = {r["path"].rsplit("/", 1)[1]: r[column] for r in hashed.collect()}
        assert prints["x.JPG"] == prints["y.jpg"] != prints["t.txt"]
    gone = spark.createDataFrame([("file:///no/such/file.jpg",)], "path string")
    assert files.fingerprints(gone).count() == files.digests(gone).count() == 0


def test_only_the_ranges_asked_for_are_read(spark, tmp_path):
    import hashlib
    import struct

    from medialake.sources import headers

    data = bytes(range(256)) * 20_000
    (tmp_path / "big file+é.jpg").write_bytes(data)
    listed = files.listing(spark, str(tmp_path))
    row = files.fingerprints(listed).first()
    assert row["taken"] == 2 * files.HEAD_BYTES
    assert row["fingerprint"] == hashlib.blake2b(struct.pack("<Q", len(data)) + data[:65536] + data[-65536:], digest_size=16).hexdigest()
    assert files.digests(listed).first()[1:] == (hashlib.blake2b(data, digest_size=20).hexdigest(), len(data))
    box = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    text = lambda t: struct.pack(">HH", len(t), 0) + t
    names = [b"com.apple.quicktime.location.ISO6709", b"com.apple.quicktime.model"]
    keys = struct.pack(">II", 0, 2) + b"".join(struct.pack(">I", len(n) + 8) + b"mdta" + n for n in names)
    items = b"".join(box(struct.pack(">I", k + 1), box(b"data", b"\0" * 8 + v)) for k, v in enumerate([b"+40.5-003.25+600/", b"Phone 3"]))
    for meta in (box(b"hdlr", b"\0" * 12), b"\0" * 4 + box(b"hdlr", b"\0" * 12)):
        clip = box(b"ftyp", b"qt  ") + box(b"mdat", b"\0" * 3_000_000) + box(b"moov", box(b"udta", box(b"\xa9mak", text(b"Acme")) + box(b"\xa9xyz", text(b"+00.0+000.0/"))) + box(b"meta", meta + box(b"keys", keys) + box(b"ilst", items)))
        path = tmp_path / "clip.mov"
        path.write_bytes(clip)
        with files.Ranged(str(path)) as part:
            assert headers.probe(part) == {"make": "Acme", "model": "Phone 3", "gps_lat": 40.5, "gps_lon": -3.25} and part.taken < 200_000
        row = headers.probed(files.listing(spark, str(tmp_path), ("mov",))).first()
        assert (row["make"], row["gps_lon"], row["width"]) == ("Acme", -3.25, None)


def tiff(order, *blocks):
    """A TIFF block of directories of (tag, kind, n, bytes); the second and third are the camera's and the place's."""
    import struct

    at, starts = 8, []
    for block in blocks:
        starts.append(at)
        at += 2 + 12 * (len(block) + (len(blocks) - 1 if block is blocks[0] else 0)) + 4
    head, tail = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), b""
    for k, block in enumerate(blocks):
        rows = list(block) + ([(0x8769, 4, 1, struct.pack(order + "I", starts[1])), (0x8825, 4, 1, struct.pack(order + "I", starts[2]))] if k == 0 else [])
        head += struct.pack(order + "H", len(rows))
        for tag, kind, n, body in rows:
            head += struct.pack(order + "HHI", tag, kind, n) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", at + len(tail)))
            tail += body if len(body) > 4 else b""
        head += b"\0" * 4
    return head + tail


def test_tags_of_camera_and_place():
    import struct

    from medialake.sources import headers

    for order in "<>":
        two = lambda *v: struct.pack(order + "I" * len(v), *v)  # noqa: B023, E731
        camera = [(0x829A, 5, 1, two(1, 200)), (0x829D, 5, 1, two(28, 10)), (0x8827, 3, 1, struct.pack(order + "H", 400)), (0x920A, 5, 1, two(0, 1)), (0xA434, 2, 8, b"50 mm\0\0\0")]
        spot = [(1, 2, 2, b"S\0"), (2, 5, 3, two(33, 1, 30, 1, 36, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, two(151, 1, 0, 1, 0, 0))]
        got = headers.probe(tiff(order, [(0x0112, 3, 1, struct.pack(order + "H", 6)), (0x010F, 2, 5, b"Acme\0")], camera, spot))
        assert got == {"orientation": 6, "make": "Acme", "exposure": 0.005, "f_number": 2.8, "iso": 400, "lens": "50 mm", "gps_lat": -33.51, "gps_lon": 151.0}
        assert headers.probe(tiff(order, [], camera, [(2, 5, 3, two(999, 1, 0, 1, 0, 1)), (4, 5, 2, two(1, 1, 2, 1))]).replace(b"50 mm", b"\0\0\0\0\0")).get("gps_lat") is None


def test_state_comes_back(spark, tmp_path):
    schema = files.STATE
    photos = spark.createDataFrame([("p", 1, 3, 0, None, "t", None, None, 5.0, "manual", 1.0), ("q", 0, 0, 0, None, None, None, None, 6.0, "exif", 1.0)], schema)
    files.write_state(photos, str(tmp_path / "state"))
    state = files.read_state(spark, str(tmp_path / "state"))
    assert [r["path"] for r in state.collect()] == ["p"]
    bare = spark.createDataFrame([("p", 0, 0, 0, None, None, None, None, 9.0, "mtime", 1.0), ("q", 0, 1, 0, None, None, None, None, 6.0, "exif", 1.0)], schema)
    back = {r["path"]: r for r in files.restored(bare, state).collect()}
    assert back["p"]["rating"] == 3 and back["p"]["title"] == "t" and back["p"]["taken_at"] == 5.0 and back["q"]["rating"] == 1


def test_stream_gives_the_batch_sessions(spark, tmp_path):
    h, base = 3600, 1_700_000_000
    rows = [(1, 0, "a"), (1, 2 * h, "a"), (1, 4 * h, "b"), (2, h, None), (1, 20 * h, "c"), (2, 9 * h, "x"), (1, 40 * h, "c"), (2, 40 * h, "x"), (1, 80 * h, "c"), (2, 80 * h, "x")]
    schema = "k int, ts timestamp, city string"
    at = lambda s: dt.datetime.fromtimestamp(base + s, dt.timezone.utc)
    folder = tmp_path / "in"
    for i, (k, s, c) in enumerate(rows):
        spark.createDataFrame([(k, at(s), c)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(folder))
    query = stream.closed_sessions(source, "k").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        found = {(r["k"], r["start_at"] - base, r["end_at"] - base, r["items"]) for r in spark.table("closed").collect()}
    finally:
        query.stop()
    df = spark.createDataFrame([(k, i, float(base + s), c) for i, (k, s, c) in enumerate(rows)], "k int, id int, taken_at double, city string")
    batch = events.sessions(df, "k").groupBy("k", "session").agg(F.min("taken_at").alias("a"), F.max("taken_at").alias("b"), F.count("*").alias("n")).collect()
    whole = {(r["k"], r["a"] - base, r["b"] - base, r["n"]) for r in batch}
    assert found <= whole and len(found) >= len(whole) - 2  # the last of each key are open
