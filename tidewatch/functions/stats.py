"""Tail probabilities. Spark has no incomplete beta or gamma function, so these are Arrow functions on small result tables."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _sf(f):
    @F.pandas_udf(T.DoubleType())
    def udf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(u) or pd.isna(v) or pd.isna(w) else f(u, v, w) for u, v, w in zip(x, a, b)], dtype="float64")

    return udf


def _student(t: float, df: float, _: float) -> float:
    half = 0.5 * _beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


_T = _sf(_student)
_F = _sf(lambda x, a, b: _beta_inc(b / 2, a / 2, b / (b + a * x)) if x > 0 else 1.0)
_CHI = _sf(lambda x, k, _: _gamma_q(k / 2, x / 2))
_NORMAL = _sf(lambda z, a, b: 0.5 * erfc(z / sqrt(2)))
_DENSITY = _sf(lambda x, df, scale: exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / (sqrt(df * 3.141592653589793) * scale) * (1 + (x / scale) ** 2 / df) ** (-(df + 1) / 2))


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) of Student's law."""
    return _T(t, df.cast("double"), F.lit(0.0))


def f_sf(x: Column, a: Column, b: Column) -> Column:
    return _F(x, a.cast("double"), b.cast("double"))


def chi2_sf(x: Column, k: Column) -> Column:
    return _CHI(x, k.cast("double"), F.lit(0.0))


def normal_sf(z: Column) -> Column:
    return _NORMAL(z, F.lit(0.0), F.lit(0.0))


def t_density(x: Column, df: Column, scale: Column) -> Column:
    """Density of Student's law with a scale."""
    return _DENSITY(x, df.cast("double"), scale)


def range_quantile(k, level: float = 0.95) -> Column:
    """Quantile of the studentised range of k normal values (infinite degrees of freedom) over sqrt(2), by integration and bisection.

    For columns of few rows: each distinct k is integrated once a batch.
    """

    @F.pandas_udf("double")
    def quantile(ks: pd.Series) -> pd.Series:
        import math

        import numpy as np

        z = np.linspace(-9, 9, 3601)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        below = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))

        def one(n: int) -> float:
            lo, hi = 0.0, 20.0
            for _ in range(50):
                q = (lo + hi) / 2
                share = n * np.trapezoid(density * (below(z) - below(z - q)) ** (n - 1), z)
                lo, hi = (q, hi) if share < level else (lo, q)
            return lo / math.sqrt(2)

        return ks.map({n: one(int(n)) if n > 1 else None for n in ks.dropna().unique()})

    return quantile(k)


# Coefficients of Acklam's rational approximation of the inverse normal distribution (relative error below 1.2e-9).
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_EDGE = 0.02425


def normal_quantile(u: Column) -> Column:
    """Inverse of the standard normal distribution for u in (0, 1), as plain arithmetic (see normal_quantile_sql)."""

    def poly(c, x):
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * x + v
        return out

    q = u - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(u)), F.sqrt(-2 * F.log(1 - u))
    tail = lambda x: poly(_TAIL, x) / poly(_TAIL_BELOW, x)
    return F.when(u < _EDGE, tail(low)).when(u > 1 - _EDGE, -tail(high)).otherwise(q * poly(_CENTRE, r) / poly(_CENTRE_BELOW, r))


def normal_quantile_sql(u: str) -> str:
    """The same in DuckDB SQL."""

    def poly(c, x):
        out = f"{c[0]!r}::DOUBLE"
        for v in c[1:]:
            out = f"({out} * {x} + {v!r}::DOUBLE)"
        return out

    tail = lambda x: f"({poly(_TAIL, x)} / {poly(_TAIL_BELOW, x)})"
    low, high, r = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))", f"(({u} - 0.5::DOUBLE) * ({u} - 0.5::DOUBLE))"
    return f"(CASE WHEN {u} < {_EDGE}::DOUBLE THEN {tail(low)} WHEN {u} > {1 - _EDGE!r}::DOUBLE THEN -{tail(high)} ELSE ({u} - 0.5::DOUBLE) * {poly(_CENTRE, r)} / {poly(_CENTRE_BELOW, r)} END)"
