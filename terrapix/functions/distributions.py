"""Distribution functions for small result tables, in plain Python."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def t_quantile(p: float, df: float) -> float:
    """Value below which a share ``p`` >= 0.5 lies, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_critical(df: Column, p: float = 0.975) -> Column:
    """:func:`t_quantile` of a column of degrees of freedom, for tables of a few rows; null below 1."""
    of = F.pandas_udf(lambda n: pd.Series([t_quantile(p, x) if x >= 1 else None for x in n], dtype="float64"), "double")
    return of(F.coalesce(df.cast("double"), F.lit(0.0)))


def t_p_value(t: Column, df: Column) -> Column:
    """:func:`t_two_sided` of two columns, for tables of a few rows; null where either is missing."""
    of = F.pandas_udf(lambda a, n: pd.Series([None if pd.isna(x) or pd.isna(k) or k < 1 else t_two_sided(x, k) for x, k in zip(a, n, strict=True)], dtype="float64"), "double")
    return of(t.cast("double"), df.cast("double"))


# Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PROBIT_LOW = 0.02425


def probit(p: Column) -> Column:
    """The normal quantile, by a rational approximation in the middle and one in each tail; null outside (0, 1)."""

    def poly(x: Column, coefficients: tuple[float, ...], tail: float | None = None) -> Column:
        out = F.lit(coefficients[0])
        for c in (*coefficients[1:], *([tail] if tail is not None else [])):
            out = out * x + c
        return out

    q = p - 0.5
    middle = poly(q * q, PROBIT_A) * q / poly(q * q, PROBIT_B, 1.0)
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(low, PROBIT_C) / poly(low, PROBIT_D, 1.0)
    inside = (p > 0) & (p < 1)
    return F.when(inside, F.when(q < PROBIT_LOW - 0.5, tail).when(q > 0.5 - PROBIT_LOW, -tail).otherwise(middle))
