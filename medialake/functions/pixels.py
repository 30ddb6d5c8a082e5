"""Pixels as arrays of numbers from 0 to 1: tone, histograms and comparison, in Spark's own functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of red, green and blue in brightness.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness per dot of three channel arrays."""
    weighted = F.zip_with(red, green, lambda r, g: r * LUMA[0] + g * LUMA[1])
    return F.zip_with(weighted, blue, lambda s, b: s + b * LUMA[2])


def tone(channel: Column, table: list[float]) -> Column:
    """Each value through a curve given at evenly spaced points, straight between them."""
    last = len(table) - 1
    curve = F.array(*map(F.lit, table))

    def one(v: Column) -> Column:
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * last
        i = F.least(F.floor(x), F.lit(last - 1)).cast("int")
        return F.get(curve, i) + (F.get(curve, i + 1) - F.get(curve, i)) * (x - i)

    return F.transform(channel, one)


def contrast(channel: Column, amount: float) -> Column:
    return F.transform(channel, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - 0.5) * (1 + amount) + 0.5)))


def histogram(channel: Column, bins: int = 16) -> Column:
    """How many values fall into each of ``bins`` equal parts."""
    place = F.transform(channel, lambda v: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(v * bins))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)))


def psnr(a: Column, b: Column) -> Column:
    """Peak signal to noise in dB of two arrays of one length; null if they are equal."""
    error = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(error > 0, F.log10(1 / error) * 10)


BLENDS = {
    "normal": lambda a, b: b, "multiply": lambda a, b: a * b, "screen": lambda a, b: 1 - (1 - a) * (1 - b), "darken": F.least, "lighten": F.greatest,
    "add": lambda a, b: F.least(F.lit(1.0), a + b), "subtract": lambda a, b: F.greatest(F.lit(0.0), a - b), "difference": lambda a, b: F.abs(a - b),
}


def blend(base: Column, top: Column, mode: str, opacity: float = 1.0) -> Column:
    return F.zip_with(base, top, lambda a, b: a + (BLENDS[mode](a, b) - a) * opacity)


@F.pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """Mean structural likeness of two grey pictures (rows of ``width`` dots) in blocks of 8 by 8."""
    c1, c2 = 0.01**2, 0.03**2

    def one(x, y, w) -> float | None:
        if x is None or y is None or not w or len(x) != len(y):
            return None
        p, q = (np.asarray(v, "f8").reshape(-1, int(w)) for v in (x, y))
        h, w = (n // 8 * 8 for n in p.shape)
        if not h or not w:
            return None
        p, q = (v[:h, :w].reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 64) for v in (p, q))
        mp, mq = p.mean(1), q.mean(1)
        cov = ((p - mp[:, None]) * (q - mq[:, None])).mean(1)
        return float(((2 * mp * mq + c1) * (2 * cov + c2) / ((mp**2 + mq**2 + c1) * (p.var(1) + q.var(1) + c2))).mean())

    return pd.Series([one(*v) for v in zip(a, b, width)], dtype="float64")
