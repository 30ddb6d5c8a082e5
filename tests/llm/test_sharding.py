import zlib
from collections import Counter

from medialake.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def brute(table, shards=40):
    """(doc_id, size, crc32, shard, slot) by a running sum over the sorted rows."""
    rows = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in table), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, before, slots, out = sum(r[2] for r in rows), 0, Counter(), []
    for i, crc, size in rows:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return Counter(out)


def test_op7_equals_a_plain_loop(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op7_sharding(spark, SF).collect()
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows) == brute(table)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in rows)


def test_odd_rows(odd, docs):
    for table in (odd, docs([(5, "x" * 9000), (1, "a"), (1, "a"), (None, None), (None, "b"), (9, "é" * 40)])):
        rows = sharding.shard_by_bytes(table).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows) == brute([(r["doc_id"], r["text"]) for r in table.collect()])
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0
