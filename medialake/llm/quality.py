"""Quality by Bradley-Terry pairwise ranking.

A preference pair is a text labelled good and one labelled bad. The chance that the good one wins is
the logistic function of the difference of their scores, which are linear in the features; the
weights are learned by the logistic loss on feature differences. A score's place against a quantile
of the labelled scores gives the decision.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, whole_text

#: The fit sees at most so many labelled rows of each kind.
FIT_ROWS = 6000
PAIRS = 60_000
STEPS = 400
RATE = 0.05
DECAY = 1e-3
#: A score at the learned cut comes out as this.
CUT = 0.7
FEATURES = 18
#: The threshold is one of these quantiles of the labelled scores.
QUANTILES = np.arange(1, 1000) / 1000


def features(text: str) -> np.ndarray:
    """Shares that describe how a text is written; none names a word or a language."""
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    byte = np.bincount(np.frombuffer(data, "u1"), minlength=256) if data else np.zeros(256, "i8")
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = byte[65:91].sum() + byte[97:123].sum() + byte[128:].sum()
    marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    plain = byte[[44, 46, 39, 45]].sum()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return np.array(
        [
            byte[65:91].sum() / max(1, letters),
            (marks - plain) / n,
            byte[124] / k,
            byte[33] / k,
            plain / n,
            byte[48:58].sum() / n,
            letters / n,
            repeats / k,
            pairs / max(1, k - 1) if k > 1 else 1.0,
            len(counts) / k**0.9,
            max(counts.values(), default=0) / k,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, n / k / 20),
            min(1.0, k / 20),
            min(1.0, k / 200),
            float((byte[65:91].sum() / max(1, letters)) > 0.3),
            float(repeats / k > 0.2),
            float((marks - plain) / k > 0.5),
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    #: The share of the labelled scores that lie below the cut.
    quantile: float = 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 8) -> Model:
    """Weights from PAIRS pairs of a good and a bad row; with one kind of label, every score is alike."""
    mean, scale = x.mean(0) if len(x) else np.zeros(FEATURES), x.std(0) + 1e-3 if len(x) else np.ones(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(FEATURES), 0.0 if len(good) else 1.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for t in range(1, STEPS + 1):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    # the quantile of the labelled scores that tells the labels apart best: the middle of the best ones
    cuts = np.quantile(raw, QUANTILES)
    gain = np.searchsorted(np.sort(raw[bad]), cuts) / len(bad) - np.searchsorted(np.sort(raw[good]), cuts) / len(good)
    best = np.flatnonzero(gain >= gain.max() - 0.002)
    quantile = float(QUANTILES[best[len(best) // 2]])
    return Model(mean, scale, w, float(np.quantile(raw, quantile)), float(1.5 / (raw.std() + 1e-6)), quantile)


def fit_rows(docs: DataFrame, labels: DataFrame, parts: int = 4, remainder: int = 2) -> Model:
    """fit() on at most FIT_ROWS whole texts of each label that aren't held out; only features reach the driver.

    A row labelled both ways is in both kinds. With no rows of a kind, all scores are alike.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch])

    picked = labelled(docs, labels, "quality", parts, remainder, FIT_ROWS)
    rows = picked.select(F.pandas_udf(run, "array<double>")("text").alias("x"), "y").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to every row of docs (a column of that name is replaced); null texts count as empty.

    Each row is scored by itself, so repeated rows get equal scores; an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(np.array([features(t) for t in batch]).reshape(-1, FEATURES)))

    return docs.withColumn("score", F.pandas_udf(run, "double")(whole_text()))
