"""Tail probabilities for aggregated statistics (a handful of rows), as Arrow UDFs.

Spark SQL has no incomplete beta or gamma function, so these few lines fill the gap.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(term, start, steps=500, eps=1e-15):
    """Continued fraction by the modified Lentz method; ``term(i) -> (numerator, denominator)``."""
    tiny = 1e-300
    f = start or tiny
    c, d = f, 0.0
    for i in range(1, steps):
        num, den = term(i)
        d = den + num * d or tiny
        c = den + num / c or tiny
        d = 1.0 / d
        f *= c * d
        if abs(c * d - 1.0) < eps:
            break
    return f


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_reg(b, a, 1.0 - x)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )

    def term(i):
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return scale / a / _fraction(term, 1.0)


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        total = t = 1.0 / s
        k = s
        while t > total * 1e-16:
            k += 1.0
            t *= x / k
            total += t
        return max(0.0, 1.0 - scale * total)
    return scale / _fraction(lambda i: (-i * (i - s), x + 2 * i + 1 - s), x + 1 - s)


def t_two_sided_value(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_reg(df / 2.0, 0.5, df / (df + t * t))


def fisher_greater_value(a: int, b: int, c: int, d: int) -> float:
    """P(X >= a) for the hypergeometric law of a 2x2 table with fixed margins."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    if a <= lo:
        return 1.0

    def log_p(k):
        lc = lambda m, r: math.lgamma(m + 1) - math.lgamma(r + 1) - math.lgamma(m - r + 1)
        return lc(row, k) + lc(n - row, col - k) - lc(n, col)

    def tail(k, step):
        p, total = math.exp(log_p(k)), 0.0
        while lo <= k <= hi:
            total += p
            if p < total * 1e-17:
                break
            if step > 0:
                p *= (row - k) * (col - k) / ((k + 1.0) * (n - row - col + k + 1.0))
            else:
                p *= k * (n - row - col + k) / ((row - k + 1.0) * (col - k + 1.0))
            k += step
        return total

    mode = (row + 1.0) * (col + 1.0) / (n + 2.0)
    return min(1.0, tail(a, 1)) if a >= mode else max(0.0, 1.0 - tail(a - 1, -1))


def _each(fn, *cols):
    rows = zip(*cols)
    return pd.Series(
        [None if any(pd.isna(v) for v in r) else fn(*r) for r in rows], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return _each(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), z)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided_value, t, df)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return _each(lambda v, n: gamma_upper(n / 2.0, v / 2.0), x, k)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(lambda *v: fisher_greater_value(*(int(x) for x in v)), a, b, c, d)
