"""Two-sided p-value of Pearson's r, evaluated for a whole Arrow batch at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _inc_beta(a, b, x, terms: int = 300):
    """Regularised incomplete beta by its continued fraction, element-wise; it ends where no factor changes a result any more."""
    def lg(v):
        # Few different sample sizes occur in a batch.
        u, at = np.unique(v, return_inverse=True)
        return np.array([math.lgamma(k) for k in u])[at]

    shift = lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            factor = c * d
            h = h * factor
        if (np.abs(factor - 1) <= 1e-15).all():
            break
    return np.exp(shift) * h / a


def pearson_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """p of r under no correlation: I_{1-r^2}((n-2)/2, 1/2); a missing r gives 1."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    p = np.ones_like(r)
    ok = np.isfinite(r) & (n > 2)
    x = np.clip(1 - r[ok] ** 2, 0.0, 1.0)
    a = (n[ok] - 2) / 2
    inner = np.ones_like(x)
    inner[x <= 0] = 0.0
    mid = (x > 0) & (x < 1)
    xs, am = x[mid], a[mid]
    half = np.full_like(xs, 0.5)
    flip = xs > (am + 1) / (am + 2.5)
    res = np.empty_like(xs)
    if (~flip).any():
        res[~flip] = _inc_beta(am[~flip], half[~flip], xs[~flip])
    if flip.any():
        res[flip] = 1 - _inc_beta(half[flip], am[flip], 1 - xs[flip])
    inner[mid] = res
    p[ok] = inner
    return p


def _batch(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(pearson_p(r.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float)))


def pearson_pvalue(r, n):
    """Column with the p-value of r over n points."""
    return F.pandas_udf(_batch, T.DoubleType())(r, n)
