"""Sequence similarity of two texts. The one function here that needs Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, the order of the arguments mattering slightly.

    Its cost is the product of both lengths, so call it on candidates only. Null counts as empty.
    """
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def _histograms(texts) -> np.ndarray:
    """How often each of 64 classes of characters occurs in each text; classes may merge characters,
    which only raises the bound below."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(codes % 64, minlength=64)
    return out


def bounded_ratio(a: pd.Series, b: pd.Series, least: float) -> pd.Series:
    """The ratio where it can reach ``least``, null where the characters in common rule that out."""
    a, b = a.fillna(""), b.fillna("")
    at, names = pd.factorize(pd.concat([a, b], ignore_index=True))
    h = _histograms(names)
    x, y = at[: len(a)], at[len(a) :]
    shared, total = np.zeros(len(a)), np.zeros(len(a))
    for lo in range(0, len(a), 20_000):
        p, q = h[x[lo : lo + 20_000]], h[y[lo : lo + 20_000]]
        shared[lo : lo + 20_000] = np.minimum(p, q).sum(axis=1)
        total[lo : lo + 20_000] = p.sum(axis=1) + q.sum(axis=1)
    can = 2 * shared >= least * total - 1e-9
    return pd.Series([_ratio(s, t) if ok else None for s, t, ok in zip(a, b, can)], dtype=float)


def sequence_ratio_from(a: Column, b: Column, least: float) -> Column:
    """``sequence_ratio`` where it may be ``least`` or more, else null or the lower ratio."""
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return bounded_ratio(x, y, least)

    return run(a, b)
