"""Toxicity by compression distance to two zstandard dictionaries.

zstandard's own trainer makes one dictionary of windows of toxic text and one of windows of ordinary
text. A window is a run of letters and digits between two spaces, a long run several overlapping ones,
so that every letter is in a window. A text's windows are compressed with either dictionary; how many
bytes shorter the toxic one must make a window, and how many such windows make a text toxic, is
calibrated on labelled rows that the dictionaries were not trained on, as is the trainer's segment size.

The trainer keeps what is frequent, and most of a toxic text is as ordinary as any other. So the toxic
dictionary is trained on those windows of toxic texts that stand out: that hold a unit (a word or the
start of one) which is in far more toxic texts than ordinary ones.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, saved, whole_text

#: The fit sees at most so many labelled rows of each kind, each as a whole.
FIT_ROWS = 3000
FIT_PARTS = 16
DICT_BYTES = 8192
#: The trainer's segments (k) and what it counts (d); k is calibrated.
SEGMENTS = (32, 48, 64)
COUNTED = 8
#: The trainer reads so many windows or so, each as often as its share asks, of so many different ordinary ones.
TRAINED_WINDOWS = 100_000
ORDINARY_WINDOWS = 20_000
WINDOW_BYTES = 32
WIDE_BYTES = 12
UNIT_BYTES = (4, 5, 6, 7, 8)
LEAST_TEXTS = 3
#: Standing out begins at these z-scores; which one is calibrated. In a few dozen toxic texts nothing comes to 6.
LEAST_Z = (4.0, 6.0, 8.0)
GAPS = (2, 3, 4, 5, 6)
COUNTS = (1, 2, 3, 4)
SHARES = (0.0, 0.001, 0.002, 0.004, 0.008)
#: Under so many windows a hit, a short text needs fewer hits than the count.
FEW = 50
#: A text of at least this score is toxic.
CUT = 0.5
#: What it costs to reject a clean text, in toxic texts kept (as shares of their kind).
REJECT_COST = 5
CACHE_WORDS = 300_000
SEED = 10
WORD = re.compile(rb"[^\x00-\x2f:-@\[-`{-\x7f]+")
#: Ends each window, and either dictionary: zstandard looks for no match in the last bytes of its input.
FILLER = b"<<window of text>> "


def windows(run: bytes) -> list[bytes]:
    """Overlapping windows that cover a long run; scripts of wide characters (three bytes or more), which may
    have no spaces, have a short one at each wide character."""
    if max(run) < 0xE0:
        half = WINDOW_BYTES // 2
        return [run[i : i + WINDOW_BYTES] for i in range(0, max(1, len(run) - half), half)]
    wide = {i for i, byte in enumerate(run) if byte >= 0xE0}
    return [run[i : i + WIDE_BYTES] for i in sorted(wide | set(range(0, len(run), WIDE_BYTES)))]


def words(text: str) -> list[bytes]:
    """The windows of a text: its lower-case runs of letters and digits, whole if they are short."""
    found = WORD.findall(text.lower().encode("utf-8", "replace"))
    return [p for w in found for p in ([w] if len(w) <= WIDE_BYTES else windows(w))]


class Gap:
    """How many bytes fewer a window takes with the toxic dictionary than with the ordinary one."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard as z

        def compressor(d: bytes) -> z.ZstdCompressor:
            how = z.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(d), min_match=4, strategy=z.STRATEGY_GREEDY, search_log=8, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=how)

        self.ordinary, self.toxic = map(compressor, dictionaries)
        self.cache: dict[bytes, int] = {}

    def __call__(self, word: bytes) -> int:
        gap = self.cache.get(word)
        if gap is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            window = b" %b %b" % (word, FILLER)
            gap = self.cache[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return gap


def enough(windows: np.ndarray | int, count: int, share: float) -> np.ndarray:
    return np.maximum(np.minimum(count, np.maximum(1, np.asarray(windows) / FEW)), share * np.asarray(windows))


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes]
    gap: int
    count: int
    share: float

    def scorer(self):
        """text -> a score from 0 to 1: 0.5 or more if enough windows are ``gap`` bytes shorter.

        Enough are ``count`` (one, in a text of up to FEW windows) and a ``share`` of all windows.
        """
        gap, least = Gap(self.dictionaries), self.gap

        def hit(word: bytes) -> bool:
            return gap(word) >= least

        def score(text: str) -> float:
            found = words(text) if self.count else []
            return float(1.0 - 0.5 ** (sum(map(hit, found)) / enough(len(found), self.count, self.share))) if found else 0.0

        return score


def units(word: bytes) -> list[bytes]:
    return [word, *(word[:k] for k in UNIT_BYTES if len(word) > k)]


def contrast(train: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(unit, z): z-score of the share of toxic texts that hold a unit against ordinary ones (text, y); rare ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["y"]):
                held[y].update({u for w in set(words(text)) for u in units(w)})
            yield pd.DataFrame([(u, held[0][u], held[1][u]) for u in {*held[0], *held[1]}], columns=["unit", "t0", "t1"])

    n0, n1 = (max(1, n) for n in sizes)
    sums = train.mapInPandas(run, "unit binary, t0 long, t1 long").groupBy("unit").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    mean = (F.col("t0") + F.col("t1")) / (n0 + n1)
    spread = F.greatest(mean * (1 - mean), F.lit(1 / (n0 + n1)))
    z = (F.col("t1") / n1 - F.col("t0") / n0) / F.sqrt(spread * (1 / n0 + 1 / n1))
    return sums.where(F.col("t1") >= LEAST_TEXTS).select("unit", z.alias("z"))


def counted(train: DataFrame, z: dict[bytes, float]) -> DataFrame:
    """(window, y, z, n): the windows of the training texts, the z-score of what stands out in them (0: nothing), how often they are there."""
    state = train.sparkSession.sparkContext.broadcast(z)  # the units of at most 2 * FIT_ROWS texts that stand out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z_ = state.value
        for batch in batches:
            for y, texts in batch.groupby("y")["text"]:
                n = Counter(w for t in texts for w in words(t))
                yield pd.DataFrame({"window": list(n), "y": y, "z": [max(z_.get(u, 0.0) for u in units(w)) for w in n], "n": list(n.values())})

    return train.mapInPandas(run, "window binary, y int, z double, n long").groupBy("window", "y", "z").agg(F.sum("n").alias("n"))


def dictionary(windows: list[tuple[bytes, int]], segment: int) -> bytes:
    """zstandard's dictionary of (window, times); of windows too few to train on, the windows themselves."""
    import zstandard as z

    total = sum(n for _, n in windows)
    samples = [b" %b " % w for w, n in sorted(windows) for _ in range(-(-n * TRAINED_WINDOWS // max(TRAINED_WINDOWS, total)))]
    samples = [samples[i] for i in np.random.default_rng(SEED).permutation(len(samples))]
    try:
        return z.train_dictionary(DICT_BYTES, samples, k=segment, d=COUNTED, level=1).as_bytes() + FILLER
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-DICT_BYTES:] + FILLER


def hits(check: DataFrame, pairs: list[tuple[bytes, bytes]]) -> list:
    """Rows (y, size, hits) of whole texts: their label, their windows, and hits by pair of dictionaries and gap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gaps = [Gap(pair) for pair in pairs]
        for batch in batches:
            counted = [Counter(words(t)) for t in batch["text"]]
            found = [[0] * (len(GAPS) * len(pairs)) for _ in counted]
            for k, gap in enumerate(gaps):
                for c, out in zip(counted, found):
                    for w, n in c.items():
                        g = gap(w)
                        for at, least in enumerate(GAPS):
                            out[k * len(GAPS) + at] += n * (g >= least)
                gap.cache.clear()  # one pair's windows are held at a time
            yield pd.DataFrame({"y": batch["y"], "size": [c.total() for c in counted], "hits": found})

    return check.mapInPandas(run, "y int, size long, hits array<long>").collect()


def fit_rows(docs: DataFrame, labels: DataFrame, parts: int = 5, remainder: int = 0) -> Model:
    """A model of at most FIT_ROWS rows of each label that aren't held out, read as whole texts by tasks.

    Dictionaries come from two thirds of the different texts, thresholds from the others; a text that
    is labelled both ways counts as toxic; one kind alone scores 0, and so does every text if no window of toxic
    texts stands out. The driver gets digests, the units and
    windows that stand out, the most frequent ordinary windows, and counts, a row a text; no text.
    """
    picked = labelled(docs, labels, "toxic", parts, remainder, FIT_ROWS).withColumn("digest", F.md5(F.col("text").cast("binary")))
    rows = saved(picked.repartition(FIT_PARTS, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.max("y").alias("y")))
    known = sorted((r["digest"], r["y"]) for r in rows.select("digest", "y").collect())
    # every third text, by its digest, is for thresholds
    held, kinds = [d for d, _ in known[::3]], [y for i, (_, y) in enumerate(known) if i % 3]
    if len(set(kinds)) < 2:
        return Model((b"", b""), 0, 0, 0.0)
    marks = F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in held], "digest string"))
    train = rows.join(marks, "digest", "left_anti")
    check = rows.join(marks, "digest", "left_semi") if len({y for _, y in known[::3]}) == 2 else train
    z = {bytes(r["unit"]): r["z"] for r in contrast(train, (kinds.count(0), kinds.count(1))).where(F.col("z") >= LEAST_Z[0]).collect()}
    seen = saved(counted(train, z))
    ordinary = [(bytes(r["window"]), r["n"]) for r in seen.where("y = 0").orderBy(F.desc("n"), "window").limit(ORDINARY_WINDOWS).collect()]
    toxic = [(bytes(r["window"]), r["n"], r["z"]) for r in seen.where((F.col("y") == 1) & (F.col("z") >= LEAST_Z[0])).collect()]
    pairs = [(dictionary(ordinary, k), dictionary([(w, n) for w, n, z in toxic if z >= least], k)) for least in LEAST_Z for k in SEGMENTS]
    found = hits(check, pairs)
    y, size, table = np.array([r["y"] for r in found]), np.array([r["size"] for r in found]), np.array([r["hits"] for r in found])
    best = None
    for (k, pair), (at, least), count, rate in itertools.product(enumerate(pairs), enumerate(GAPS), COUNTS, SHARES):
        said = table[:, k * len(GAPS) + at] >= enough(size, count, rate)
        right = said[y == 1].mean() - REJECT_COST * said[y == 0].mean()
        key = (round(right, 2), least, -count, -rate, k)
        if best is None or key > best[0]:
            best = key, Model(pair, least, count, rate)
    return best[1]


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Adds the score to every row of docs (a column of that name is replaced); null texts count as empty.

    A text without words scores 0. Each row is scored by itself, so repeated rows get equal scores,
    and an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype="float64")

    return docs.withColumn(column, F.pandas_udf(run, "double")(whole_text()))
