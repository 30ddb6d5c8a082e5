import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medialake.llm import pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def test_op4_base(spark):
    rows = queries.op4_pii(spark, SF).collect()
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = brute(r["text"])
        n = Counter(k for _, k, _ in base)
        want[(r["doc_id"], *(n[k] for k in pii.KINDS), hashlib.sha256(joined(base).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "@", "a", ".", "1.2.3.4", "256.1.1.1.1", "4539578763621486", " ", "-", "+1 (212) 555-0100", "+", "5", "(", "é", "\n", "4539 5787 6362 1486", "x@y", "..", "%"]), max_size=14).map("".join))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@b" * 60_000, "x1" * 100_000])
def test_long_runs_are_quick(text):
    spans = pii.base_spans(text)
    list(pii.candidates(text, spans))


def mails(n):
    return [(i, f"filler words{i % 7} please ring +1 (212) 555-01{i:02} today") for i in range(n)]


def test_contexts_find_unseen_numbers(docs):
    table = [*mails(20), (100, "then please ring 212 555 0199 today"), (101, "we sold 212 555 0188 apples"), (102, "again 212 555 0199 here")]
    rows = {r["doc_id"]: r for r in pii.find_personal(docs(table)).collect()}
    assert [(s["kind"], table[20][1][s["start"] : s["end"]]) for s in rows[100]["spans"]] == [("phone", "212 555 0199")]
    assert rows[101]["spans"] == []  # another context
    assert [s["kind"] for s in rows[102]["spans"]] == ["phone"]  # a known value anywhere
    assert all(set(r["base"]) <= set(r["spans"]) for r in rows.values())
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs(table)).collect()}
    assert text[100] == "then please ring [phone] today" and text[101] == table[21][1] and text[0].endswith("ring [phone] today")


def test_odd_rows(odd, docs):
    rows = pii.find_personal(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert pii.find_personal(odd.limit(0)).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and Counter(r["text"] for r in out.collect()) == Counter(r["text"] for r in odd.collect())
    assert out.limit(0).count() == 0


def test_long_words_and_values_count_as_a_whole(docs):
    """A word of 300 letters before a value is one pattern; a value of over 64 characters is a candidate."""
    word = "w" * 300
    mail = "who@" + "h" * 80
    table = [*((i, f"{word} +1 (212) 555-01{i:02} and mail n{i}@host{i}.org soon") for i in range(20)), (100, f"{word} 212 555 0199 and mail {mail} soon"), (101, "w" * 299 + " 212 555 0177 and")]
    rows = {r["doc_id"]: r for r in pii.find_personal(docs(table)).collect()}
    assert [(s["kind"], table[20][1][s["start"] : s["end"]]) for s in rows[100]["spans"]] == [("phone", "212 555 0199"), ("email", mail)]
    assert rows[101]["spans"] == []


@pytest.mark.parametrize("text", ["a@b.cc," * 30_000, "x" * 200_000 + " 1.2.3.4 " + "y" * 200_000, "1.2.3.4 " * 30_000, "(1.2.3.4)" * 20_000, "." * 200_000 + "1.2.3.4"])
def test_contexts_are_linear(text):
    import time

    began = time.time()
    for a, _, b in pii.base_spans(text):
        pii.contexts(text, a, b)
    assert time.time() - began < 5


def test_redact_keeps_columns_named_like_its_own(odd):
    clash = odd.withColumn("__digest", F.lit("x")).withColumn("__spans", F.lit("y"))
    out = pii.redact(clash)
    assert out.columns == clash.columns and {(r["__digest"], r["__spans"]) for r in out.collect()} == {("x", "y")}
