"""Periodic runs of words by probing harmonic grids.

A run of period p is at least three periods long, so two neighbouring multiples of p, and the words p
after them, lie in it, wherever it starts. For each p the words at jp and (j+1)p are compared, n / p of
them, n log n in all. A point survives if the next one does too and the words right after it agree with
those p later; from there on chunks of the two shifted arrays are compared to both sides. Points in a
run whose period divides p are left out: they can only lead to that run again, as the first word beyond
it breaks its own period and so p. Points in a run of p just found are skipped.

Texts are laid end to end, longest first, with a number of its own between two, so that one numpy call
serves one p for all texts that are long enough for it. Every text is read by one task, once; nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words right after a grid point that are compared for all points at once, before chunks are.
PROBED = 16
FIRST_CHUNK, LARGEST_CHUNK = 64, 1 << 16
#: Texts are put together up to so many words; a longer text is alone.
WORDS_TOGETHER = 1 << 20


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def equal_after(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from ``at`` on, going by step (1 or -1), hold the word that is ``period`` later."""
    n, chunk = 0, FIRST_CHUNK
    while True:
        if step > 0:
            a, b = at + n, min(at + n + chunk, len(words) - period)
            differ = words[a:b] != words[a + period : b + period]
        else:
            a, b = max(0, at - n - chunk + 1), at - n + 1
            differ = (words[a:b] != words[a + period : b + period])[::-1]
        if b <= a:
            return n
        if differ.any():
            return n + int(differ.argmax())
        n += b - a
        chunk = min(2 * chunk, LARGEST_CHUNK)


class Covered:
    """The runs found so far; ``by`` says which pairs (x, x + period) lie in one whose period divides it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.table = np.empty((0, 3), "i8")

    def add(self, start: int, length: int, period: int) -> None:
        self.rows.append((start, length, period))

    def by(self, x: np.ndarray, period: int) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, "i8")
        own = self.table[period % self.table[:, 2] == 0] if len(self.table) else self.table
        if not len(own):
            return np.zeros(len(x), bool)
        own = own[np.argsort(own[:, 0], kind="stable")]
        reach = np.maximum.accumulate(own[:, 0] + own[:, 1])
        before = np.searchsorted(own[:, 0], x, "right") - 1
        return (before >= 0) & (reach[before] > x + period)


def find(words: np.ndarray, ends: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    words: a number a word, equal for equal words. ends: period -> how much of words can hold runs of it,
    for texts laid end to end (None: one text).
    """
    found = Covered()
    period = 0
    while True:
        period += 1
        end = len(words) if ends is None else ends.get(period, 0)
        if end < least_length(period):
            break
        here = words[:end]
        grid = here[::period]
        same = grid[:-1] == grid[1:]
        x = np.flatnonzero(same[:-1] & same[1:]) * period
        if len(x) and found.rows:
            x = x[~found.by(x, period)]
        for k in range(1, min(period, PROBED) + 1):
            if not len(x):
                break
            x = x[x + k + period < end]
            x = x[here[x + k] == here[x + k + period]]
        past = 0
        for at in x.tolist():
            if at < past:
                continue
            right = equal_after(here, at, period, 1)
            left = equal_after(here, at, period, -1) - 1
            past = at + right
            if left + right + period >= least_length(period):
                found.add(at - left, left + right + period, period)
    return sorted(found.rows, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat: list = []
    for i in order:
        flat += texts[i]
        flat.append(None)
    numbers, _ = pd.factorize(np.array(flat, dtype=object))
    numbers[starts[1:] - 1] = -1 - np.arange(len(order))  # the end of each text is like nothing else
    last, ends = int(sizes[0]) // LEAST_PERIODS, {}
    for period, many in enumerate(np.searchsorted(-sizes, [-least_length(p) for p in range(1, last + 1)], "right").tolist(), 1):
        ends[period] = int(starts[many])
    for start, length, period in find(numbers, ends):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]), length, period))
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def together(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words of each text), up to WORDS_TOGETHER words at a time. bytes.split() parts at 20, 09-0D, no others."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch["doc_id"], batch["data"]):
            words = data.split()
            if n and n + len(words) > WORDS_TOGETHER:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            n += len(words)
    if ids:
        yield ids, texts


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed) of each row's whole text.

    Words are what stands between spaces and the characters 09 to 0D; start counts words from 0. A run is
    a longest stretch whose smallest period is ``period``, of 24 words and three periods or more. runs come
    by start, then period. collapsed is the text with one period of each run left, words joined by a space.

    Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids give
    a row each; other columns, whatever their names, are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in together(batches):
            found = runs_of_texts(texts)
            yield pd.DataFrame({
                "doc_id": ids, "n_words": [len(t) for t in texts], "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found],
                "collapsed": [kept(t, r) for t, r in zip(texts, found)],
            })

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), whole_text().cast("binary").alias("data"))
    rows = rows.mapInPandas(run, "doc_id decimal(20,0), n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def greatest(runs: Column) -> Column:
    """The run with the most periods, exactly compared; of several the first."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of rows whose h = crc32(doc_id) is a multiple of 10, the words from a on repeat the first p of them.

    With n words and g = h // 10: a = g mod n, p = 1 + (n - a) // (3 + g mod 8). Null ids have no h.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", whole_text().alias("text")).withColumns({"h": h, "words": F.when(h % 10 == 0, words)})
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))
