"""Packing token streams into fixed windows by minimum bin slack.

Each document is cut into whole windows and one remainder. How often each remainder length occurs is
a table of at most ``capacity`` rows. For one window at a time, a bitset subset-sum over these counts
finds the multiset of remaining lengths that fills the window closest to capacity; it is used as
often as the counts allow, so a length runs short each time and the plan stays bounded by the
capacity, whatever the number of documents. Spark numbers the remainders of each length by prefix
sums and places them by the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import running, saved, sliced, whole_text

CAPACITY = 1024
END_ID = 0


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset (length, times) within counts whose sum is closest to capacity from below.

    The longest length left is always in, as in minimum bin slack; the rest is a subset sum: bit s
    of a set tells whether s can be filled, and the sets kept per step give the counts back.
    """
    longest = max(counts)
    room = capacity - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == longest), room // length)
        before, k = reach, 1
        while most > 0:  # powers of two cover every number of copies up to most
            k_now = min(k, most)
            reach |= (reach << (length * k_now)) & mask
            most, k = most - k_now, k * 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {longest: 1}
    for length, before in reversed(steps):
        while not before >> left & 1:
            left -= length
            used[length] = used.get(length, 0) + 1
    return sorted(used.items(), reverse=True)


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, copies)])]: window patterns that use up all counts."""
    counts, plan = {n: c for n, c in counts.items() if c > 0}, []
    while counts:
        pattern = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in pattern)
        plan.append((times, pattern))
        for n, k in pattern:
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per window-sized piece of each text's ids (and the end id)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.packed(text) + end
                n = len(ids) // 4
                doc_id = None if doc_id is None else int(doc_id)
                out += [(doc_id, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all texts: one row per piece, with its sequence_id and its offset in it.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text
    is the end id alone; equal rows are packed each; null doc_ids stay null; other columns of docs
    are left aside; an empty table gives an empty one.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity))  # read three times below; tokenized once
    pieces = pieces.withColumn("whole", (F.col("length") == capacity).cast("int")).withColumn("one", F.lit(1))
    pieces = sliced(pieces, "doc_id", "doc_tokens", "start", "ids_crc32")
    counts = {r["length"]: r["n"] for r in pieces.where("whole = 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # under capacity rows
    plan = plan_windows(counts, capacity)
    places: dict[int, list] = {}
    first, taken = 0, dict.fromkeys(counts, 0)
    for times, pattern in plan:
        at = 0
        for length, copies in pattern:
            places.setdefault(length, []).append((taken[length], copies, first, at))
            taken[length] += times * copies
            at += length * copies
        first += times
    table = {n: tuple(np.array(x, "i8") for x in zip(*rows)) for n, rows in places.items()}
    order = ["doc_id", "doc_tokens", "start", "ids_crc32"]
    numbered = running(pieces, order, {"rank": "one"}, by=["length"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            sequence, offset = first + rank, np.zeros_like(rank)  # whole windows follow the packed ones
            for n in np.unique(length):
                if n == capacity:
                    continue
                here = np.flatnonzero(length == n)
                starts, copies, firsts, at = table[int(n)]
                k = np.searchsorted(starts, rank[here], "right") - 1
                own = rank[here] - starts[k]
                sequence[here] = firsts[k] + own // copies[k]
                offset[here] = at[k] + own % copies[k] * n
            yield batch.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)")).mapInPandas(place, "doc_id decimal(20,0), start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))
