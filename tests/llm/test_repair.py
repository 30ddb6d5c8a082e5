import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from medialake.llm import queries, repair

SF = "/root/testdata/sf0.01"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def harmed(rows):
    """The rows after damage, by the contract, in plain Python."""
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def cheapest(rows):
    """(cost, audit, repaired turns) by a search over whole strings: the least (cost, string) first.

    The grammar is a regular expression on what came out; a string that can't be completed is dropped.
    """
    begun = re.compile("s?(ua)*u?")
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, out, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, turns
        state = (i, out[-1:], out == "s", audit if len(rows) < 8 else "")  # every string of short ones
        if state in seen:
            continue
        seen.add(state)
        nexts = []
        if i < len(rows):
            role, text, fault = rows[i]
            nexts.append((2, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                nexts.append((more, "K", i + 1, role[:1] or "?", ((role, text),)))
                nexts += [(1 + more, "R", i + 1, r[0], ((r, text),)) for r in ("user", "assistant")]
        if not audit.endswith("III"):
            nexts += [(5, "I", i, r[0], ((r, ""),)) for r in ("user", "assistant")]
        for more, label, j, initial, turn in nexts:
            if begun.fullmatch(out + initial):
                heapq.heappush(heap, (cost + more, audit + label, j, out + initial, turns + turn))


def want(known, rows):
    """The contract's row for each conversation."""
    space = re.compile(r"[\x20\x09-\x0D]+$")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = []
    for conv in set(known):
        turns = {t for t, _, _ in by[conv]} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = lambda role, text: hashlib.sha256("\n".join([" " if conv is None else str(conv), str(len(role)), role, text]).encode()).digest()  # noqa: B023, E731
        ordered = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(*r[1:])))
        seen, found, counts = set(), [], Counter()
        for _, role, text in ordered:
            bare = space.sub("", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            found.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        cost, audit, turns = cheapest(found)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return Counter(out)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df, known, rows):
    assert Counter(tuple(r[c] for c in COLUMNS) for r in df.collect()) == want(known, rows)


def test_op12_equals_a_search_over_strings(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversation_repair(spark, SF), [r[0] for r in table], harmed(table))


def wild(rng, conv):
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    texts = ["Yes.", "No!", "cut", " \t", "", None, "Why? \n", "x\x1c"]
    return [(conv, rng.choice([None, *range(6)]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts)) for _ in range(rng.randint(0, 8))]


@pytest.mark.parametrize("per_slice", [200_000, 7])
def test_wild_conversations_whole_and_in_many_blocks(spark, monkeypatch, per_slice):
    monkeypatch.setattr(repair, "ROWS_PER_SLICE", per_slice)
    rng = random.Random(5)
    rows = [r for conv in [None, *range(120)] for r in wild(rng, conv)]
    rows += [(500, i, ("user", "assistant")[i // 2 % 2], f"{i}" + ".,"[i % 7 == 0]) for i in range(60)]
    rows += [(501, 1, "user", "again.")] * 40
    table = spark.createDataFrame(rows, CONVERSATIONS)
    known = [r[0] for r in rows]
    space = lambda r: (r[0], r[1], *(" " if x is None else x for x in r[2:]))
    same(queries.repair_digest(table, table), known, map(space, rows))
    if per_slice > 7:
        same(queries.repair_digest(table, repair.damaged(table)), known, harmed(rows))


def test_ranks_stand_for_strings():
    """Random blocks: the path carried by ranks is the least of all strings, and tables put together give the same."""
    rng = random.Random(1)
    for _ in range(300):
        rows = "".join(rng.choice(repair.ROWS) for _ in range(rng.randint(0, 6)))
        found = []
        for row in rows:
            k = repair.ROWS.index(row)
            found.append(({"s": "system", "u": "user", "a": "assistant", "o": "tool"}["suao"[k // 4]], "", ("", "blank", "duplicate", "truncated")[k % 4]))
        cost, audit, _ = cheapest(found)
        cut = rng.randint(0, len(rows))
        assert repair.finished([repair.arcs(r) for r in rows])[:2] == (cost, audit)
        assert repair.finished([repair.block_table(rows[:cut]), repair.block_table(rows[cut:])])[:2] == (cost, audit)


def test_odd_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "long " * 50_000 + ".")], CONVERSATIONS)
    clash = table.withColumns({c: F.lit(7) for c in ("slice", "pos", "digest", "rows", "row", "initial", "fault", "tie", "first", "block", "conv", "h", "time", "sub")})
    same(queries.repair_digest(clash, clash), [1], [tuple(r) for r in table.collect()])
    assert queries.repair_digest(clash.limit(0), repair.damaged(clash.limit(0))).count() == 0
