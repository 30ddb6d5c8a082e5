import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from medialake.llm import bpe, packing, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(queries.tokenizer_path())


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def check_codes(rows, df, tok):
    want = Counter()
    for i, t in texts(df):
        ids = tok.encode(t, add_special_tokens=False).ids
        want[(i, tuple(ids), tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want


def test_codes_equal_the_library(spark, odd, tok):
    check_codes(bpe.encode_decode(odd, queries.tokenizer_path()).collect(), odd, tok)
    assert bpe.encode_decode(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_op2_digests(spark, tok):
    want = set()
    for i, t in texts(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in queries.op2_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_fullest_window():
    assert packing.fullest({600: 1, 424: 1, 500: 2}, 1024) == [(600, 1), (424, 1)]
    assert packing.fullest({300: 9}, 1024) == [(300, 3)]
    counts = {700: 3, 200: 5, 124: 2, 90: 7, 13: 4}
    plan = packing.plan_windows(counts, 1024)
    used = Counter()
    for times, pattern in plan:
        assert sum(n * k for n, k in pattern) <= 1024
        for n, k in pattern:
            used[n] += times * k
    assert used == counts


def check_packing(rows, df, tok):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, t in texts(df):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            want[(i, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 1024) + 2 or total / (1024 * len(by_sequence)) > 0.98


def test_packing(spark, odd, tok):
    check_packing(packing.pack(odd, queries.tokenizer_path()).collect(), odd, tok)
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_op9(spark, tok):
    check_packing(queries.op9_packing(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet"), tok)


def test_sharding(spark, odd):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts(odd))
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0


def test_op7_is_contiguous_and_balanced(spark):
    rows = sorted(queries.op7_sharding(spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    total, largest, by = sum(r["size"] for r in rows), max(r["size"] for r in rows), Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert all(abs(by[s] - total / 40) <= largest for s in range(40))
    assert [(r["shard"], r["slot"]) for r in rows] == sorted((r["shard"], r["slot"]) for r in rows)
