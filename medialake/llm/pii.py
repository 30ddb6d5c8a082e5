"""Personal data: fixed patterns, and more identifiers by bootstrapped contexts.

What the fixed patterns find are seeds. The words around a seed are lexical patterns; patterns and
the values that stand in them form a graph, whose edges Spark counts once. In each round a pattern's
confidence in a kind is the share of its values that are known to be of the kind, a value's score is
one minus the product of its patterns' doubts, and values of a plausible form whose score is high
become known and count in the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, saved, whole_text

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts if it holds so many different known values of a kind, and they are this share of its values.
LEAST_VALUES = 3
LEAST_SHARE = 0.6
#: A value is taken for known from this score on.
ACCEPT = 0.9

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]\S*")
EDGES = ".,;:!?\"'()[]{}<>|*$%&#"
NUMBER = re.compile(r"[0-9]+")
UNIT = re.compile(r"\s*((?:[^\w\s]|_)*[^\W_]*)")
NUMERIC = re.compile(r"[\x200-9().-]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Like a search for local part and domain, but in steps from @ to @, so that long words cost no square."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        if m:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + len(".".join(parts[k : k + 4]))
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as in KINDS."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(a, 1, b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def plausible(value: str) -> list[str]:
    """The kinds that a value may be of, by its form."""
    n = sum(c in "0123456789" for c in value)
    plain = not any(c.isalpha() for c in value)
    return [k for k, yes in zip(KINDS, ("@" in value[1:-1], plain and 3 < n <= 12 and 3 <= value.count(".") + value.count(":"), plain and 12 <= n <= 19, plain and 7 <= n <= 15)) if yes]


def candidates(text: str, known: list[tuple[int, str, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @ that no span covers, without the marks around them; runs of numbers are one."""
    taken = sorted((a, b) for a, _, b in known)
    held = None
    k = 0
    for m in MARKED.finditer(text):
        start, end = m.span()
        while start > 0 and not text[start - 1].isspace():  # once a token, as MARKED takes its rest
            start -= 1
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= end or any(a < end and b > start for a, b in taken[k : k + 4]):
            continue
        if held and start == held[1] + 1 and text[held[1]] == " " and NUMERIC.fullmatch(text, *held) and NUMERIC.fullmatch(text, start, end):
            held = held[0], end
            continue
        if held:
            yield held
        held = start, end
    if held:
        yield held


def unit_before(text: str, end: int) -> tuple[str, int]:
    """The word before a place, with the marks between, and where it starts; numbers are written 9."""
    at = end
    while at > 0 and text[at - 1].isspace():
        at -= 1
    stop = at
    while at > 0 and not text[at - 1].isspace() and not text[at - 1].isalnum():
        at -= 1
    while at > 0 and text[at - 1].isalnum():
        at -= 1
    return NUMBER.sub("9", text[at:stop].lower()), at


def unit_after(text: str, start: int) -> str:
    """What follows a place: marks, then a word; numbers are written 9."""
    return NUMBER.sub("9", UNIT.match(text, start)[1].lower())


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the patterns around a span: one and two words before it, and one on either side.

    Words are whole, however long: what lies between two spans is read for few of them, so this is linear.
    """
    last, at = unit_before(text, start)
    out = []
    if last:
        out.append("l " + last)
        more = unit_before(text, at)[0]
        if more:
            out.append("ll " + more + " " + last)
        after = unit_after(text, end)
        if after:
            out.append("lr " + last + " _ " + after)
    return [xxhash.xxh64_intdigest(p, 0) - 2**63 for p in out]


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans, and values: the seeds and candidates with their patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, values, digests = [], [], []
            for text in batch["text"]:
                base = base_spans(text)
                rows = [{"start": a, "end": b, "kind": k, "value": text[a:b], "may": [], "patterns": contexts(text, a, b)} for a, k, b in base]
                for a, b in candidates(text, base):
                    may = plausible(text[a:b])
                    rows.append({"start": a, "end": b, "kind": None, "value": text[a:b], "may": may, "patterns": contexts(text, a, b)})
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                values.append(rows)
                digests.append(xxhash.xxh128_digest(text.encode("utf-8", "replace")))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": digests, "base": bases, "values": values})

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), whole_text().alias("text"))
    value = "struct<start:long,end:long,kind:string,value:string,may:array<string>,patterns:array<long>>"
    rows = rows.mapInPandas(run, f"doc_id decimal(20,0), digest binary, base array<struct<start:long,kind:string,end:long>>, values array<{value}>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def bootstrap(values: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind): values that their patterns make known, of (kind, value, may, patterns) rows."""
    edges = values.select("value", "kind", "may", F.explode("patterns").alias("pattern"))
    edges = saved(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed"), F.max("may").alias("may")))
    known = edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("weight", F.lit(1.0))
    seeds, learned = known, None
    for _ in range(rounds):
        marked = edges.join(known, "value", "left")
        sums = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in KINDS]
        stats = marked.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("sum")) for k in KINDS)))
        sure = stats.select("pattern", "n", kinds.alias("of")).select("pattern", "of.kind", F.least(F.col("of.sum") / (F.col("n") + 1), F.lit(0.99)).alias("share"), F.col("of.sum").alias("sum"))
        sure = sure.where((F.col("sum") >= LEAST_VALUES) & (F.col("share") >= LEAST_SHARE))
        fresh = edges.where("seed is null and size(may) > 0").join(sure, "pattern").where(F.array_contains("may", F.col("kind")))
        scored = fresh.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("weight")).where(F.col("weight") >= ACCEPT)
        learned = saved(scored.groupBy("value").agg(F.max_by("kind", F.struct("weight", "kind")).alias("kind"), F.max("weight").alias("weight")))
        known = seeds.unionByName(learned.join(seeds.select("value"), "value", "left_anti"))
    return learned.select("value", "kind")


def find_personal(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, digest, base and spans (array<struct<start,kind,end>>, by start, then kind) of every row.

    Offsets are code points. base is what the fixed patterns find, spans also what contexts make
    known; every text that holds a known value has it marked. Null texts count as empty; equal texts
    have equal spans; a value counts once per pattern however often it repeats; rows with null or
    repeated ids stay; an empty table gives an empty one.
    """
    found = saved(find_base(docs).withColumn("uid", F.monotonically_increasing_id()))
    values = found.select("uid", F.explode("values").alias("v")).select("uid", "v.*")
    learned = bootstrap(values, rounds)
    more = values.where("kind is null").select("uid", "start", "end", "value").join(learned, "value")
    more = more.groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    joined = found.join(more, "uid", "left")
    spans = F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,kind:string,end:long>>"))))
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return joined.select("doc_id", "digest", "base", spans.alias("spans"))


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; the other columns as they are.

    Null texts stay null, texts without spans as they are, repeated rows stay; an empty table gives an empty one.
    """
    found = find_personal(docs, rounds).where("size(spans) > 0").groupBy("digest").agg(F.first("spans").alias("spans"))

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([xxhash.xxh128_digest(t.encode("utf-8", "replace")) for t in batch])

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, list_ in zip(texts, spans):
                if list_ is not None:
                    parts, at = [], 0
                    for s in list_:
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{s['kind']}]"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pd.Series(out, dtype="object")

    key, marked = free("digest", docs), free("spans", docs)
    keyed = docs.withColumn(key, F.pandas_udf(digest, "binary")(whole_text()))
    joined = keyed.join(found.select(F.col("digest").alias(key), F.col("spans").alias(marked)), key, "left")
    return joined.withColumn("text", F.pandas_udf(cut, "string")("text", marked)).select(*docs.columns)
