"""Tail probabilities for test statistics, applied to one-row results.

Regularised incomplete beta and gamma functions by their published series and
continued fractions (Abramowitz and Stegun, chapters 6 and 26).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-14
# The fractions take about the root of the degrees of freedom; not ending is an error.
_STEPS = 20_000_000
# Denominator degrees of freedom beyond which an F tail equals its chi-square limit to
# 1e-9: the next term of the expansion is of the order of one over them.
_LARGE = 1e12


def _guard(x: float) -> float:
    return _TINY if abs(x) < _TINY else x


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / _guard(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / _guard(1.0 + term * d)
            c = _guard(1.0 + term / c)
            total *= c * d
        if abs(c * d - 1.0) < _EPS:
            return total
    raise ArithmeticError("the beta fraction did not settle")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                return 1.0 - total * math.exp(log_front)
        raise ArithmeticError("the gamma series did not settle")
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / _guard(b)
    total = d
    for n in range(1, _STEPS):
        step = -n * (n - a)
        b += 2.0
        d = 1.0 / _guard(step * d + b)
        c = _guard(b + step / c)
        total *= c * d
        if abs(c * d - 1.0) < _EPS:
            return math.exp(log_front) * total
    raise ArithmeticError("the gamma fraction did not settle")


def chi2_tail(x: float, k: float) -> float:
    return gamma_tail(k / 2.0, x / 2.0)


def f_tail(f: float, d1: float, d2: float) -> float:
    if f <= 0.0:
        return 1.0
    if d2 > _LARGE:
        return chi2_tail(d1 * f, d1)
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return f_tail(t * t, 1.0, df)


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal, at most 1."""
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided tail of the rank-sum statistic without ties, from its exact counts."""
    few, many = int(min(n1, n2)), int(max(n1, n2))
    ways = np.zeros(few * many + 1)
    ways[0] = 1.0
    # Counts of rank sums: multiply by (1 - q^(many+i)) and divide by (1 - q^i).
    for i in range(1, few + 1):
        up = ways.copy()
        up[many + i :] -= ways[: -(many + i)] if many + i < len(ways) else 0.0
        for start in range(i):
            up[start::i] = np.cumsum(up[start::i])
        ways = up
    upper = ways[int(math.ceil(max(u, n1 * n2 - u))) :].sum()
    return min(1.0, 2.0 * upper / ways.sum())


def _applied(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        rows = zip(*[s.astype("float64") for s in series])
        return pd.Series([None if any(map(math.isnan, r)) else function(*r) for r in rows], dtype="float64")

    return tail(*[c.cast("double") for c in columns])


def t_p(t: Column, df: Column) -> Column:
    return _applied(t_tail, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _applied(f_tail, f, d1, d2)


def chi2_p(x: Column, k: Column) -> Column:
    return _applied(chi2_tail, x, k)


# Sizes up to which the rank-sum tail is counted exactly.
EXACT_SAMPLE = 8


def u_p(u: Column, z: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Exact for a small sample without ties, else the normal approximation."""

    def tail(u, z, n1, n2, ties):
        if ties == 0 and min(n1, n2) <= EXACT_SAMPLE:
            return exact_u_tail(u, int(n1), int(n2))
        return normal_tail(z)

    return _applied(tail, u, z, n1, n2, ties)
