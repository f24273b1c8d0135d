"""Tail probabilities as Pandas UDFs; they run on one row per test."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_LIMIT = 8


@lru_cache(maxsize=16)
def _part_table(parts: int) -> tuple[int, list[int]]:
    """(period, counts): ways to fill up to y with parts 1..n, for the first periods.

    Within one residue of the period the count is a polynomial of degree ``parts`` in y.
    """
    period = math.lcm(*range(1, parts + 1))
    ways = [1] * (period * (parts + 1))  # a slack of any size
    for part in range(1, parts + 1):
        for y in range(part, len(ways)):
            ways[y] += ways[y - part]
    return period, ways


def _filled(parts: int, y: int) -> int:
    """Ways to fill up to y with parts 1..n, exact for any y."""
    period, ways = _part_table(parts)
    if y < len(ways):
        return ways[y] if y >= 0 else 0
    step, rest = divmod(y, period)
    total = Fraction(0)
    for j in range(parts + 1):  # Lagrange through the first periods
        term = Fraction(ways[rest + j * period])
        for i in range(parts + 1):
            if i != j:
                term *= Fraction(step - i, j - i)
        total += term
    return int(total)


def exact_u_p(u: float, n_a: int, n_b: int) -> float:
    """Two-sided exact p; the cost depends on the smaller group only.

    Arrangements by U are the coefficients of prod (1 - q^(n+i)) / (1 - q^i); their sum up to
    a limit follows by inclusion and exclusion over the numerator's factors.
    """
    small, large = sorted((n_a, n_b))
    extreme = max(u, n_a * n_b - u)
    limit = n_a * n_b - math.ceil(extreme)  # the distribution is symmetric
    count = 0
    for chosen in range(1 << small):
        used = sum(large + i + 1 for i in range(small) if chosen >> i & 1)
        if used <= limit:
            count += (-1) ** chosen.bit_count() * _filled(small, limit - used)
    return float(min(Fraction(1), Fraction(2 * count, math.comb(small + large, small))))


def normal_u_p(u: float, n_a: float, n_b: float, ties: float) -> float:
    n = n_a + n_b
    var = n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (max(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / math.sqrt(var)
    return float(min(1.0, math.erfc(z / math.sqrt(2.0))))


def mann_whitney_p(u: str, n_a: str, n_b: str, ties: str, exact: bool = True) -> Column:
    """Two-sided p: exact for tie-free groups of which one is small, if wanted, else normal."""

    @F.pandas_udf("double")
    def p(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for s, a, b, t in zip(u, n_a, n_b, ties):
            if a == 0 or b == 0:
                out.append(None)
            elif exact and min(a, b) <= EXACT_LIMIT and t == 0:
                out.append(exact_u_p(s, int(a), int(b)))
            else:
                out.append(normal_u_p(s, float(a), float(b), float(t)))
        return pd.Series(out, dtype="float64")

    return p(F.col(u), F.col(n_a), F.col(n_b), F.col(ties))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def student_p(t: str, df: str) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(
            [
                student_two_sided(a, b) if np.isfinite(a) and np.isfinite(b) and b > 0 else None
                for a, b in zip(t.astype("float64"), df.astype("float64"))
            ],
            dtype="float64",
        )

    return p(F.col(t), F.col(df))
