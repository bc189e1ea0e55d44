"""Special functions in numpy, and their Arrow-batched column forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    shapes, back = np.unique(np.stack([a.ravel(), b.ravel()]), axis=1, return_inverse=True)
    const = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in shapes.T])[back.ravel()].reshape(x.shape)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(const + a * np.log(z) + b * np.log1p(-z))
    low = z < (a + 1) / (a + b + 2)
    out = np.where(low, front * _fraction(a, b, z) / a, 1 - front * _fraction(b, a, 1 - z) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_p(t, df) -> np.ndarray:
    """Two-sided p of Student's t; not finite gives NaN."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    tt, dd = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(dd / 2, 0.5, dd / (dd + tt * tt)), np.nan)


def t_quantile(q: float, df: float) -> float:
    """Quantile over 0.5 by bisection."""
    low, high = 0.0, 1.0
    while t_p(high, df) / 2 > 1 - q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) / 2 > 1 - q else (low, mid)
    return (low + high) / 2


def normal_cdf(z) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(z, float) / math.sqrt(2))


@pandas_udf(DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_p(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def _normal_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(z.to_numpy(float)))


def t_two_sided(t: Column, df: Column) -> Column:
    return _t_udf(t, df)


def normal(z: Column) -> Column:
    return _normal_udf(z)
