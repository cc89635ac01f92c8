"""Tail probabilities of a test statistic.

Spark has no normal, t or chi-square distribution function. A test yields one
row, so these run on that single aggregated row, never on the data.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Executors need not have this package: the functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny = 1e-300

    def guarded(value: float) -> float:
        return value if abs(value) > tiny else tiny

    c, d = 1.0, 1.0 / guarded(1.0 - (a + b) * x / (a + 1.0))
    result = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 / guarded(1.0 + term * d)
            c = guarded(1.0 + term / c)
            step = c * d
            result *= step
        if abs(step - 1.0) < 1e-15:
            break
    return result


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    log_front = (
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def _student_two_sided(t: float, df: float) -> float:
    return _beta_share(df / 2.0, 0.5, df / (df + t * t))


def _chi_square_upper(x: float, df: int) -> float:
    """Whole degrees of freedom: a finite sum, with an error-function start when odd."""
    half = x / 2.0
    if df % 2 == 0:
        term = total = math.exp(-half)
        steps = range(1, df // 2)
        offset = 0.0
    else:
        total = math.erfc(math.sqrt(half))
        term = math.exp(-half) * math.sqrt(half / math.pi) * 2.0
        if df > 1:
            total += term
        steps = range(1, (df - 1) // 2)
        offset = 0.5
    for i in steps:
        term *= half / (i + offset)
        total += term
    return total


EXACT_GROUP = 8  # the smaller group up to which rank sums without ties are counted exactly


def _rank_sum_upper(u: int, small: int, large: int) -> float:
    """Share of the arrangements of two groups without ties whose U is at least ``u``.

    U's counts are the coefficients of the product of ``(1 - q^(large+i)) / (1 - q^i)`` for i up
    to ``small``. With every denominator brought to ``1 - q^L``, L a common multiple, a sum of
    coefficients is a sum of binomials: exact, and as fast for a billion values as for ten.
    """
    most = small * large - u  # by symmetry as many arrangements lie at or below this
    if most < 0:
        return 0.0
    common = math.lcm(*range(1, small + 1))
    # a last factor 1 / (1 - q) adds up the coefficients
    numerator = [1]
    for step in [1, *range(1, small + 1)]:
        spread = [0] * (len(numerator) + common - step)
        for start in range(0, common, step):
            for k, ways in enumerate(numerator):
                spread[start + k] += ways
        numerator = spread
    shifts = {0: 1}
    for i in range(1, small + 1):
        moved = dict(shifts)
        for at, sign in shifts.items():
            moved[at + large + i] = moved.get(at + large + i, 0) - sign
        shifts = moved
    count = 0
    for at, sign in shifts.items():
        left = most - at
        if left < 0 or not sign:
            continue
        for k in range(left % common, min(left + 1, len(numerator)), common):
            count += sign * numerator[k] * math.comb((left - k) // common + small, small)
    return count / math.comb(small + large, small)


def _unknown(*values) -> bool:
    return any(pd.isna(v) for v in values)


@F.pandas_udf(T.DoubleType())
def rank_sum_upper_tail(z: pd.Series, u: pd.Series, n1: pd.Series, n2: pd.Series, exact: pd.Series) -> pd.Series:
    """Exact where ``exact`` says so, which bounds the smaller group; else the normal tail of ``z``."""
    return pd.Series(
        [
            math.nan if _unknown(*row[:4]) or not min(row[2:4]) else
            _rank_sum_upper(int(row[1]), int(min(row[2:4])), int(max(row[2:4]))) if row[4] else _normal_upper(row[0])
            for row in zip(z, u, n1, n2, exact)
        ]
    )


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [math.nan if _unknown(a, b) else _student_two_sided(a, b) for a, b in zip(t, df)]
    )


@F.pandas_udf(T.DoubleType())
def chi_square_upper_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [math.nan if _unknown(a, b) else _chi_square_upper(a, int(b)) for a, b in zip(x, df)]
    )
