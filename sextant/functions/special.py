"""Special functions that Spark lacks, as vectorised column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _erf(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erf, x.ravel().tolist()), float, x.size).reshape(x.shape)


_inverse = np.vectorize(lambda p: NormalDist().inv_cdf(p) if 0 < p < 1 else math.nan, otypes=[float])


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta, of whole arrays, by a continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    tiny = 1e-300
    d, f, c = np.zeros_like(a), np.ones_like(a), np.ones_like(a)
    for i in range(400):
        m = i // 2
        if i == 0:
            n = np.ones_like(a)
        elif i % 2 == 0:
            n = m * (b - m) * inside / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * inside / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 + n * d, 1 + n / c
        d, c = 1 / np.where(d == 0, tiny, d), np.where(c == 0, tiny, c)
        f = f * c * d
        if i and (np.abs(c * d - 1) < 1e-14).all():
            break
    value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * (f - 1)))
    return np.where(turned, 1 - value, value)


def t_tail(t, df, alternative: str = "greater") -> np.ndarray:
    """p-values of Student's t; NaN where t or df is none, or df is not above 0."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    known = ~np.isnan(t) & (df > 0)
    x, k = np.where(known, t, 0.0), np.where(known, df, 1.0)
    upper = 0.5 * incomplete_beta(k / 2, 0.5, k / (k + x * x))
    upper = np.where(x >= 0, upper, 1 - upper)
    p = {"greater": upper, "less": 1 - upper, "two-sided": 2 * np.minimum(upper, 1 - upper)}[alternative]
    return np.where(known, p, np.nan)


def normal_cdf(x: Column) -> Column:
    @F.pandas_udf("double")
    def phi(s: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf_array(s))

    return phi(x.cast("double"))


def normal_quantile(p: Column) -> Column:
    @F.pandas_udf("double")
    def inverse(s: pd.Series) -> pd.Series:
        return pd.Series(_inverse(s))

    return inverse(p.cast("double"))


def t_pvalue(t: Column, df: Column, alternative: str = "greater") -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_tail(a.to_numpy(float), b.to_numpy(float), alternative))

    return tail(t.cast("double"), df.cast("double"))
