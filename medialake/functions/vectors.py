"""Vectors as bytes: half and single floats, little-endian, as side files keep them (in base64)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decoded(kind: str):
    width = np.dtype(kind).itemsize

    def decode(data: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or len(b) % width else np.frombuffer(b, kind).astype("f4") for b in data], dtype=object)

    return F.pandas_udf(decode, T.ArrayType(T.FloatType()))


def _encoded(kind: str):
    def encode(vectors: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([None if v is None else np.asarray([np.nan if x is None else x for x in v], "f4").astype(kind).tobytes() for v in vectors], dtype=object)

    return F.pandas_udf(encode, T.BinaryType())


#: Bytes to vectors; null for nulls and for lengths that aren't whole numbers of values. Subnormals, infinities and NaN come through.
from_half, from_single = _decoded("<f2"), _decoded("<f4")
#: Vectors to bytes, rounded to even; beyond 65,504 a half is infinite, null components are NaN.
to_half, to_single = _encoded("<f2"), _encoded("<f4")
