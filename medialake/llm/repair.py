"""Conversation repair by composing three weighted machines.

The input acceptor spells a conversation's rows, the edit transducer keeps, reroles, deletes or inserts
turns at a cost, and the role grammar accepts ``(s?(ua)+)?`` on the initials of what comes out. They are
composed lazily, only states that a row leads to are made, and the shortest path is taken in
topological order: row by row, insertions before a row counted up (two suffice, three would pass a
grammar state twice). A weight is (cost, labels), compared by cost, then by the string of labels.

Paths that meet at a row all end in an edit of that row, so none of their strings starts another, and
the order of two strings never changes when both are continued. A string is therefore carried as its rank
among the few states of its row and a pointer back. For the same reason paths can be put together from
blocks: rows are range-partitioned by conversation and turn, a block is the part of a conversation in one
slice, its table holds the best path from each grammar state to each, and a second path goes over the
tables. A conversation of any size is split; texts stay where they are until the edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_SLICE, saved

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
INITIALS = "suao"  # o: none of the three
#: A row as a letter: its initial and its first fault (0: none).
ROWS = "ABCDEFGHIJKLMNOP"
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = {START, ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


@lru_cache(None)
def edits(row: str) -> tuple[tuple[int, str, str], ...]:
    """(cost, label, initial that comes out) of what the transducer does with a row."""
    initial, fault = INITIALS[ROWS.index(row) // 4], ROWS.index(row) % 4
    if fault in (BLANK, DUPLICATE):
        return ((DELETE, "D", ""),)
    more = UNFINISHED if fault == TRUNCATED else 0
    return ((more, "K", initial), (REROLE + more, "R", "u"), (REROLE + more, "R", "a"), (DELETE, "D", ""))


def inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, initials) after no, one or two insertions."""
    came = ""
    yield state, 0, came
    for n in (1, 2):
        initial = "a" if state == USER else "u"
        state, came = GRAMMAR[state, initial], came + initial
        yield state, n * INSERT, came


@lru_cache(None)
def arcs(row: str) -> dict[int, dict[int, Weight]]:
    """The composed arcs of a row: state -> next state -> least weight, insertions before the row included."""
    out: dict[int, dict[int, Weight]] = {}
    for state in range(4):
        best: dict[int, Weight] = {}
        for mid, paid, came in inserted(state):
            for cost, label, initial in edits(row):
                after = GRAMMAR.get((mid, initial)) if initial else mid
                weight = (paid + cost, "I" * len(came) + label)
                if after is not None and (after not in best or weight < best[after]):
                    best[after] = weight
        out[state] = best
    return out


def shortest(tables: list[dict[int, dict[int, Weight]]], start: int) -> dict[int, tuple[int, int, list[tuple[int, str]]]]:
    """The best paths through tables of arcs: last state -> (cost, rank of its labels, (state before, labels) of each table)."""
    best, back = {start: (0, 0)}, []
    for table in tables:
        reached: dict[int, tuple] = {}
        for state, (cost, rank) in best.items():
            for after, (more, labels) in table[state].items():
                weight = (cost + more, rank, labels, state)
                if after not in reached or weight < reached[after]:
                    reached[after] = weight
        order = {s: k for k, s in enumerate(sorted(reached, key=lambda s: reached[s][1:3]))}
        best = {s: (w[0], order[s]) for s, w in reached.items()}
        back.append({s: (w[3], w[2]) for s, w in reached.items()})
    out = {}
    for last, (cost, rank) in best.items():
        state, path = last, []
        for step in reversed(back):
            path.append(step[state])
            state = path[-1][0]
        out[last] = (cost, rank, path[::-1])
    return out


@lru_cache(1 << 14)
def block_table(rows: str) -> dict[int, dict[int, Weight]]:
    """The arcs of a whole block."""
    tables = [arcs(r) for r in rows]
    return {start: {last: (cost, "".join(x for _, x in path)) for last, (cost, _, path) in shortest(tables, start).items()} for start in range(4)}


def finished(tables: list[dict[int, dict[int, Weight]]]) -> tuple[int, str, list[int], str]:
    """(cost, labels, states before each table and at the end, initials inserted at the end) of the best accepted path."""
    best = None
    for last, (cost, rank, path) in shortest(tables, START).items():
        for state, paid, came in inserted(last):
            if state in FINAL:
                weight = (cost + paid, rank, "I" * len(came))
                if best is None or weight < best[0]:
                    best = (weight, path, [s for s, _ in path] + [last], came)
                break
    (cost, _, tail), path, states, came = best
    return cost, "".join(x for _, x in path) + tail, states, came


@lru_cache(1 << 14)
def row_edits(rows: str, start: int, last: int) -> list[tuple[str, str, str]]:
    """(edit, initial that comes out, initials inserted before) of each row of a block."""
    path = shortest([arcs(r) for r in rows], start)[last][2]
    initial, out = {(s, t): i for (s, i), t in GRAMMAR.items()}, []
    for (state, labels), after in zip(path, [s for s, _ in path[1:]] + [last]):
        mid, _, came = list(inserted(state))[len(labels) - 1]
        out.append((labels[-1], "" if labels[-1] == "D" else initial[mid, after], came))
    return out


def shown(name: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest: the last tells rows of another conversation, role or text apart."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"))
    whole = F.concat_ws("\n", shown("conv_id"), F.length("role").cast("string"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, row (a letter of ROWS with fault 0, 1 or 3), slice, pos: the order of all rows, without texts. Saved."""
    spark = rows.sparkSession
    text = F.rtrim("text", F.lit(SPACE))
    fault = F.when(text == "", BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    light = rows.select("conv_id", "turn", "role", "digest", initial.alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "digest", "tie"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, rows.count() // ROWS_PER_SLICE + 1)
    return saved(light.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "digest", "initial", "fault", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("pos")))


def blocks(ordered: DataFrame) -> DataFrame:
    """conv_id, slice, rows (a letter each), pos, digest (arrays). Saved. A row is a duplicate if an equal one has a lesser pos."""
    first = ordered.groupBy("digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    row = F.substring(F.lit(ROWS), 1 + 4 * F.col("initial") + fault, F.lit(1))
    flagged = ordered.join(first, "pos", "left").select("conv_id", "slice", "pos", "digest", row.alias("row"))
    sets = flagged.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list(F.struct("pos", "row", "digest"))).alias("all"))
    return saved(sets.select("conv_id", "slice", F.array_join("all.row", "").alias("rows"), F.col("all.pos").alias("pos"), F.col("all.digest").alias("digest")))


BLOCK = "slice int, first string, last string, blank long, duplicate long, truncated long, illegal long, arcs array<struct<start:int,last:int,cost:long,labels:string>>"


def measured(made: DataFrame) -> DataFrame:
    """(conv_id, block): the ends, counts and arcs of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, piece, rows in zip(batch["conv_id"], batch["slice"], batch["rows"]):
                at = [ROWS.index(r) for r in rows]
                roles = "".join(INITIALS[k // 4] for k in at)
                illegal = sum(roles[k : k + 2] not in LEGAL for k in range(len(roles) - 1))
                table = [{"start": s, "last": t, "cost": c, "labels": x} for s, to in block_table(rows).items() for t, (c, x) in to.items()]
                out.append((conv, piece, roles[0], roles[-1], *(sum(k % 4 == f for k in at) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, table))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "slice", "first", "last", "blank", "duplicate", "truncated", "illegal", "arcs"])

    rows = made.select(F.col("conv_id").cast("decimal(20,0)").alias("conv_id"), "slice", "rows").mapInPandas(run, f"conv_id decimal(20,0), {BLOCK}")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(*rows.columns[1:]).alias("block"))


PATH = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, through array<struct<slice:int,start:int,last:int,after:string>>"


def paths(conversations: DataFrame, ordered: DataFrame, made: DataFrame) -> DataFrame:
    """A row per conversation: gaps, faults, cost, audit, and the states through which each of its blocks is passed. Saved."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gaps = ordered.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    parts = measured(made).unionByName(gaps, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    parts = parts.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"), F.collect_list("block").alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, gap, found in zip(batch["conv_id"], batch["gaps"], batch["blocks"]):
                found = sorted(found, key=lambda b: b["slice"])
                tables = [{s: {a["last"]: (a["cost"], a["labels"]) for a in b["arcs"] if a["start"] == s} for s in range(4)} for b in found]
                cost, labels, states, tail = finished(tables)
                counts = [sum(b[c] for b in found) for c in ("blank", "duplicate", "truncated", "illegal")]
                counts[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(found, found[1:]))
                through = [{"slice": b["slice"], "start": s, "last": t, "after": tail if k == len(found) - 1 else ""} for k, (b, s, t) in enumerate(zip(found, states, states[1:]))]
                out.append((conv, gap, *counts, cost, labels, through))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "through"])

    rows = parts.select(F.col("conv_id").cast("decimal(20,0)").alias("conv_id"), "gaps", "blocks").mapInPandas(run, f"conv_id decimal(20,0), gaps long, {PATH}")
    return saved(rows.withColumn("conv_id", F.col("conv_id").cast("long")))


def edited(made: DataFrame, path: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, edit, initial, before, after) of each row: what is done with it, the initials inserted around it."""
    through = path.select(F.col("conv_id").alias("conv"), F.explode("through").alias("t")).select("conv", "t.*")
    columns = ["conv_id", "pos", "digest", "edit", "initial", "before", "after"]
    both = made.join(through, made["conv_id"].eqNullSafe(through["conv"]) & (made["slice"] == through["slice"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for conv, rows, pos, digest, start, last, after in zip(*(batch[c] for c in batch.columns)):
                done = row_edits(rows, start, last)
                out += [(conv, p, d, *e, after if k == len(done) else "") for k, (p, d, e) in enumerate(zip(pos, digest, done), 1)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    rows = both.select(made["conv_id"].cast("decimal(20,0)").alias("conv_id"), "rows", "pos", "digest", "start", "last", "after")
    rows = rows.mapInPandas(run, "conv_id decimal(20,0), pos long, digest binary, edit string, initial string, before string, after string")
    return rows.withColumn("conv_id", F.col("conv_id").cast("long"))


def turns(initials: str) -> Column:
    """Empty turns of the roles that the initials stand for."""
    one = lambda i: F.struct(F.when(i == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    return F.transform(F.filter(F.split(initials, ""), lambda i: i != ""), one)


def repair(conversations: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The faults and the cheapest repair of each conversation, and the repaired turns.

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per conv_id, and
    (conv_id, pos, sub, role, text), the turns that are left in the order of pos and sub. Rows go by turn,
    nulls first, those of one turn by role, then by a hash of role and text. Null roles and texts are one
    space; rows with a null conv_id are a conversation; conversations of ``known`` that have no row have
    nothing to repair; repeated rows are duplicates; other columns are
    left out; an empty table gives empty tables. See rules and costs at the top of this module: keep 0,
    rerole 1, delete 2 (the only edit of a blank or duplicate row), insert 5, a truncated row that stays 5.
    """
    rows = rows_of(conversations)
    ordered = in_order(rows)
    made = blocks(ordered)
    path = paths(conversations if known is None else known, ordered, made)
    done = edited(made, path)
    texts = rows.groupBy("digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    joined = done.where("edit <> 'D' or before <> '' or after <> ''").join(texts, "digest")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("initial") == "u", "user").otherwise("assistant")
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    left = joined.select("conv_id", "pos", F.posexplode(F.concat(turns("before"), own, turns("after"))).alias("sub", "turn"))
    return path.drop("through"), left.select("conv_id", "pos", "sub", "turn.role", "turn.text")


def spelled_sha256(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of ``role:text`` of each turn, joined by newlines.

    One hash goes over a whole conversation, so its turns pass through one task: sorted by Spark, as a
    stream of batches, never held together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha, any_yet = None, None, False
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if any_yet and conv == now:
                    sha.update(b"\n")
                else:
                    if any_yet:
                        out.append((now, sha.hexdigest()))
                    now, sha, any_yet = conv, hashlib.sha256(), True
                sha.update(role.encode())
                sha.update(b":")
                sha.update(text.encode())
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        if any_yet:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["conv_id", "repaired_sha256"])

    rows = repaired.withColumn("conv_id", F.col("conv_id").cast("decimal(20,0)")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")
    rows = rows.select("conv_id", "role", "text").mapInPandas(run, "conv_id decimal(20,0), repaired_sha256 string")
    return rows.withColumn("conv_id", F.col("conv_id").cast("long"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with a fault in a quarter of the rows, by h = crc32("conv_id:turn") mod 20.

    0: the row is dropped; 1: its text is empty; 2: its text loses every ``.``, ``!`` and ``?``; 3: it comes
    twice; 4: its role is user. Nulls (of ids and turns in the hashed string, of roles and texts) are one space.
    """
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")
