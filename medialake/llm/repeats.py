"""Exact repeated passages by a sorted array of sampled suffixes.

A byte is repeated if a string of ``LENGTH`` bytes around it also starts elsewhere. Not every suffix
is sorted: each window of LENGTH bytes picks one anchor, the K bytes in it whose hash is least, so
equal windows pick the same anchor at the same offset, and comparing suffixes at anchors finds every
repeat. Anchors whose hash is nowhere else are dropped first. The suffixes at the others, with what
stands before them, are range-partitioned by their leading bytes under splitters that Spark samples;
a bucket sorts its suffixes by multikey quicksort (three-way splits on eight bytes at a time), and
compares neighbours. Splitters cut only between different leading bytes, so suffixes on the two
sides of a boundary differ within their first K bytes: no repeat crosses one. A start that more than
HOT_SUFFIXES suffixes share is split deeper: windows that start near the anchor need more bytes in
common after it, those that start far before it more bytes before it, so each part of the offsets
has longer leading bytes of its own. Where a part is one offset, they are the whole window.

A window that starts d bytes before its anchor is repeated if another suffix shares d bytes to the
left and LENGTH - d to the right; runs of neighbours whose common prefix (or, sorted from the right,
common suffix) is long enough are the classes that decide it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, saved, whole_text

LENGTH = 200
K = 64
SIDE = LENGTH - K
CHUNK = 1 << 19
#: Leading bytes that more suffixes share are split deeper, their offsets in so many parts a time.
HOT_SUFFIXES = 1024
PARTS = 4
SUFFIXES_PER_BUCKET = 40_000
PLACE_BITS = 20
#: Hash parameters: odd multipliers for strings of 1, 2, 4, ... bytes.
SEED = 6


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, 256, dtype="u8"), rng.integers(0, 2**64, 7, dtype="u8") | np.uint64(1)


def anchors(data: bytes, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of the anchors of the windows of ``data``; first and last are window starts."""
    letters, odd = _PARAMETERS
    h, step = letters[np.frombuffer(data, "u1")], 1
    while step < K:
        h = h[:-step] * odd[step.bit_length() - 1] + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(29))) * odd[6]
    h ^= h >> np.uint64(32)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype="u8")
    step, width = 1, SIDE + 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if width > step:
        v = np.minimum(v[: step - width], v[width - step :])
    place = (v & mask).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    place = place[first]
    return h[place].view("i8"), place + start, first + start, last + start


_PARAMETERS = _parameters()


def chunks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of bounded size that hold every window once."""
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        yield a, data[a : a + CHUNK + LENGTH - 1]


def sort_suffixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long byte rows, within groups: (order, common prefix with the row before).

    Each pass splits the runs that are still equal by the next eight bytes into smaller, equal and
    larger; rows of a run that has split to one are done. The first row of a group has prefix -1.
    """
    n, width = rows.shape
    wide = -(-width // 8)
    digits = np.zeros((n, wide * 8), "u1")
    digits[:, :width] = rows
    digits = digits.view(">u8").astype("u8")
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if n else np.empty(0, "i8")
    common = np.full(n, width, "i8")
    if n:
        common[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] = -1
    at = np.arange(n)  # places whose run has more than one row
    for depth in range(wide):
        if n:
            r = run[at]
            alone = np.concatenate([[True], r[1:] != r[:-1]]) & np.concatenate([r[1:] != r[:-1], [True]]) if len(r) else np.empty(0, bool)
            at = at[~alone]
        if not len(at):
            break
        digit = digits[order[at], depth]
        by = np.lexsort((digit, run[at]))
        order[at], digit = order[at][by], digit[by]
        r = run[at]
        split = np.concatenate([[False], (r[1:] == r[:-1]) & (digit[1:] != digit[:-1])])
        here = np.flatnonzero(split)
        differ = digit[here] ^ digit[here - 1]
        same = 7 - np.floor(np.log2(np.maximum(differ, 1).astype("f8"))).astype("i8") // 8
        # log2 in doubles can round up just below a power of two
        same += (differ >> ((7 - same) * 8).astype("u8") == 0).astype("i8")
        common[at[here]] = np.minimum(8 * depth + same, width)
        whole = run.copy()
        jump = np.zeros(n, "i8")
        jump[at[here]] = 1
        run = whole + np.cumsum(jump)
    return order, common


def repeated_windows(context: np.ndarray, least: np.ndarray, most: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, the least and the largest offset d of a repeated window (least > largest: none).

    context holds SIDE bytes before the anchor and LENGTH from it on; only windows with offsets from
    ``least`` to ``most`` belong to the anchor. weight: how often the row occurs.
    """
    n = len(context)
    low, high = np.full(n, LENGTH, "i8"), np.full(n, -1, "i8")
    if not n:
        return low, high
    right, prefix = sort_suffixes(context[:, SIDE:], np.zeros(n, "i8"))
    group = np.empty(n, "i8")
    group[right] = np.cumsum(prefix < K)
    left, suffix = sort_suffixes(np.ascontiguousarray(context[:, SIDE - 1 :: -1]), group)
    for d in range(SIDE + 1):
        mine = np.flatnonzero((least <= d) & (most >= d))
        if not len(mine):
            continue
        rc, lc = np.empty(n, "i8"), np.empty(n, "i8")
        rc[right] = np.cumsum(prefix < LENGTH - d)
        lc[left] = np.cumsum((suffix < d) | (suffix < 0))
        _, which = np.unique(lc[mine] * (n + 1) + rc[mine], return_inverse=True)
        many = mine[np.bincount(which, weights=weight[mine])[which] > 1]
        low[many] = np.minimum(low[many], d)
        high[many] = d
    return low, high


def fingerprinted(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest (SHA-256), n_bytes, hashes of the anchors (distinct, and again if one is there twice)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for data in batch["data"]:
                parts = [anchors(c, a)[:2] for a, c in chunks(data)]
                h = np.concatenate([p[0] for p in parts] or [np.empty(0, "i8")])
                place = np.concatenate([p[1] for p in parts] or [np.empty(0, "i8")])
                _, one = np.unique(place, return_index=True)
                h, n = np.unique(h[one], return_counts=True)
                found.append(np.concatenate([h, h[n > 1]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": [hashlib.sha256(d).digest() for d in batch["data"]], "n_bytes": [len(d) for d in batch["data"]], "hashes": found})

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), whole_text().cast("binary").alias("data"))
    rows = rows.mapInPandas(run, "doc_id decimal(20,0), digest binary, n_bytes long, hashes array<long>")
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "digest", "n_bytes", "hashes")


def suffixes(texts: DataFrame) -> DataFrame:
    """(uid, places, context, least, most) of the anchors in ``hashes`` of each text; equal ones of a text once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for uid, data, wanted in zip(batch["uid"], batch["data"], batch["hashes"]):
                found: dict[tuple, list] = {}
                for a, chunk in chunks(data):
                    h, place, first, last = anchors(chunk, a)
                    for k in np.flatnonzero(np.isin(h, wanted)).tolist():
                        p, d0, d1 = int(place[k]), int(place[k] - last[k]), int(place[k] - first[k])
                        before, after = data[max(0, p - SIDE) : p], data[p : p + LENGTH]
                        found.setdefault((before.rjust(SIDE, b"\0") + after.ljust(LENGTH, b"\0"), d0, d1), []).append(p)
                out += [(uid, np.array(at, "<u4").tobytes(), context, d0, d1) for (context, d0, d1), at in found.items()]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["uid", "places", "context", "least", "most"])
                    out = []
            yield pd.DataFrame(out, columns=["uid", "places", "context", "least", "most"])

    return texts.select("uid", "data", "hashes").mapInPandas(run, "uid long, places binary, context binary, least int, most int")


def leading() -> Column:
    """The bytes that suffixes have in common if a window at an offset from ``lo`` to ``hi`` repeats."""
    return F.substring("context", F.lit(SIDE + 1) - F.col("lo"), F.col("lo") + LENGTH - F.col("hi"))


def split_hot(rows: DataFrame, hot_suffixes: int) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes, each with offsets lo to hi so that few share its leading bytes, and (uid, places, low, high).

    Offsets lo to hi see only some of a context. Suffixes that are alike in all of that are decided at
    once, these are the latter table (None: none are), and one of them goes on, for others to meet, into
    the parts of lo to hi that its own offsets touch.
    """
    key, row = ["lo", "hi", "lead"], ["uid", "places", "lo", "hi"]
    level = saved(rows.select("*", F.lit(0).alias("lo"), F.lit(SIDE).alias("hi")))
    cool, sure = None, None
    while True:
        led = level.withColumn("lead", leading())
        hot = saved(led.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_suffixes).select(key))
        if hot.isEmpty():
            return level if cool is None else cool.unionByName(level), sure
        own = led.join(hot, key, "left_anti").drop("lead")
        cool = own if cool is None else cool.unionByName(own)
        view = F.md5(F.substring("context", F.lit(SIDE + 1) - F.col("hi"), F.col("hi") + LENGTH - F.col("lo")))
        shared = saved(led.join(hot, key, "left_semi").drop("lead").withColumn("seen", view))
        alike = shared.groupBy("lo", "hi", "least", "most", "seen").agg(F.min(F.struct("uid", "places", "context")).alias("one"), F.count("*").alias("n"))
        alike = saved(alike.select("one.*", "least", "most", "lo", "hi", "n"))
        decided = shared.join(alike.where("n = 1").select(row), row, "left_anti").select("uid", "places", F.col("least").cast("long").alias("low"), F.col("most").cast("long").alias("high"))
        sure = decided if sure is None else sure.union(decided)
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / PARTS).cast("int")
        first = (F.col("lo") + F.floor((F.col("least") - F.col("lo")) / F.col("step")) * F.col("step")).cast("int")
        parts = alike.where("lo < hi").drop("n").withColumn("step", step).withColumn("lo", F.explode(F.sequence(first, F.col("most").cast("int"), F.col("step"))))
        parts = parts.withColumn("hi", F.least(F.col("hi"), F.col("lo") + F.col("step") - 1)).drop("step")
        level = saved(parts.withColumns({"least": F.greatest("least", "lo"), "most": F.least("most", "hi")}))


def compared(rows: DataFrame, buckets: int) -> DataFrame:
    """(uid, places, low, high): suffixes of which windows at offsets low to high are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = pd.concat(list(batches) or [pd.DataFrame({c: [] for c in ("uid", "places", "context", "least", "most")})])
        context = np.frombuffer(b"".join(bucket["context"]), "u1").reshape(-1, SIDE + LENGTH)
        weight = np.array([len(p) // 4 for p in bucket["places"]], "i8")
        low, high = repeated_windows(context, bucket["least"].to_numpy("i8"), bucket["most"].to_numpy("i8"), weight)
        keep = low <= high
        yield pd.DataFrame({"uid": bucket["uid"].to_numpy("i8")[keep], "places": bucket["places"].to_numpy()[keep], "low": low[keep], "high": high[keep]})

    dealt = rows.repartitionByRange(buckets, "lo", "hi", leading()).drop("lo", "hi")
    return dealt.mapInPandas(run, "uid long, places binary, low long, high long")


def merged(intervals: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, maximal (start, end) rows."""
    if not len(intervals):
        return np.empty((0, 2), "i8")
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    new = np.concatenate([[True], intervals[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([intervals[first, 0], reach[np.concatenate([first[1:] - 1, [len(intervals) - 1]])]], axis=1)


def find_repeats(docs: DataFrame, hot_suffixes: int = HOT_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """The rows, and the texts that lose bytes.

    Returns (uid, doc_id, digest, n_bytes, copies) for each row of docs, where copies counts the rows
    of the same text, and (uid, digest, spans array<struct<start,end>>, kept binary) for texts that
    hold repeats and have no copy. A text of LENGTH bytes or more that has copies loses everything.

    Matches never cross texts; null texts count as empty; texts shorter than LENGTH lose nothing and
    cause nothing; rows with null doc_ids or repeated rows count like any other; an empty table gives
    empty tables. Rows of one text are compared once, so that copies make no group large.
    """
    rows = saved(fingerprinted(docs))
    texts = saved(rows.groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")))
    one = rows.join(texts.select("uid", "copies"), "uid")  # a row of each text
    anchored = one.select("uid", F.explode("hashes").alias("h"))
    shared = anchored.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    wanted = anchored.distinct().join(shared, "h").groupBy("uid").agg(F.collect_list("h").alias("hashes"))
    wanted = saved(wanted.join(one.select("uid", "doc_id", "digest", "copies"), "uid"))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("data"))
    full = full.withColumn("digest", F.unhex(F.sha2("data", 256)))
    near = full.join(wanted, (full["digest"] == wanted["digest"]) & full["doc_id"].eqNullSafe(wanted["doc_id"]))
    near = near.select("uid", wanted["digest"], "data", "hashes", "copies")
    # rows that share doc_id and text, or null ids, come once each: the text is then a copy anyway
    near = saved(near)
    dealt, sure = split_hot(suffixes(near), hot_suffixes)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // SUFFIXES_PER_BUCKET + 1)
    spans = compared(dealt, parts)
    spans = spans if sure is None else spans.unionByName(sure)
    found = spans.groupBy("uid").agg(F.collect_list(F.struct("places", "low", "high")).alias("found"))
    cut = near.where("copies = 1").select("uid", "digest", "data").join(found, "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, digest, data, found_ in zip(batch["uid"], batch["digest"], batch["data"], batch["found"]):
                pieces = [np.stack([p - f["high"], p - f["low"] + LENGTH], axis=1) for f in found_ for p in (np.frombuffer(f["places"], "<u4").astype("i8"),)]
                gone = merged(np.concatenate(pieces)).tolist()
                ends = [0, *(e for _, e in gone)]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(data)]))
                out.append((uid, digest, [{"start": a, "end": b} for a, b in gone], kept))
            yield pd.DataFrame(out, columns=["uid", "digest", "spans", "kept"])

    kept = cut.mapInPandas(run, "uid long, digest binary, spans array<struct<start:long,end:long>>, kept binary")
    return rows.drop("hashes").join(texts.select("digest", "copies"), "digest"), kept


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes of each text removed (its other columns as they are).

    Text is what the kept bytes spell; bytes of a character that was cut apart are left out. Null texts
    stay null; texts shorter than LENGTH bytes stay as they are; copies lose everything; an empty table
    gives an empty one. A column that is named like one used inside keeps its name and values.
    """
    rows, kept = find_repeats(docs)
    copied = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("digest").distinct()
    changed = kept.select("digest", F.col("kept")).union(copied.select("digest", F.lit(b"")))
    digest, left = free("digest", docs), free("kept", docs)
    keyed = docs.withColumn(digest, F.unhex(F.sha2(whole_text().cast("binary"), 256)))
    joined = keyed.join(changed.select(F.col("digest").alias(digest), F.col("kept").alias(left)), digest, "left")

    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if b is None else b.decode("utf-8", "ignore") for b in batch], dtype="object")

    return joined.withColumn("text", F.coalesce(F.pandas_udf(spell, "string")(left), "text")).select(*docs.columns)
