"""Tail probabilities for small result tables (one row per key), as Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return float("nan")
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def binomial_at_least(k: float, n: float) -> float:
    """P(X >= k) for n fair coins, by the incomplete beta function."""
    return 1.0 if k <= 0 else beta_cdf(k, n - k + 1, 0.5)


def _columns(fn, *args: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def apply(*cols: pd.Series) -> pd.Series:
        rows = zip(*[c.astype(float) for c in cols])
        return pd.Series([None if any(math.isnan(v) for v in r) else fn(*r) for r in rows], dtype="float64")

    return apply(*args)


def normal_p(z: Column) -> Column:
    return _columns(normal_two_sided, z.cast("double"))


def student_p(t: Column, df: Column) -> Column:
    return _columns(student_two_sided, t.cast("double"), df.cast("double"))


def binomial_p(k: Column, n: Column) -> Column:
    return _columns(binomial_at_least, k.cast("double"), n.cast("double"))
