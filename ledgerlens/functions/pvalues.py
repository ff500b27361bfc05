"""Two-sided p-values for small result tables.

Spark SQL has no error function or incomplete beta/gamma, so these few lines of
numerics run as Arrow-batched functions over result rows (one per feature or
test, never over data rows).
"""

import math

import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-300
STEPS = 500


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _fraction(first: float, terms) -> float:
    """Continued fraction by the modified Lentz method; ``terms`` yields (a, b)."""
    value = first or TINY
    upper, lower = value, 0.0
    for a, b in terms:
        lower = b + a * lower
        lower = 1.0 / (lower or TINY)
        upper = (b + a / upper) or TINY
        step = upper * lower
        value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def regularised_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularised_beta(1.0 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)

    def terms():
        for m in range(STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return math.exp(log_front) / (a * _fraction(1.0, terms()))


def t_two_sided(t: float, df: float) -> float:
    return regularised_beta(df / (df + t * t), df / 2.0, 0.5)


def correlation_p(r: float, n: float) -> float:
    """p-value of a correlation through the t distribution with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def chi2_upper(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable: the upper regularised gamma Q(df/2, x/2)."""
    if x <= 0.0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    log_front = a * math.log(half) - half - math.lgamma(a)
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        for _ in range(10 * STEPS):
            k += 1.0
            term *= half / k
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - math.exp(log_front) * total
    terms = ((-i * (i - a), half + 2 * i + 1 - a) for i in range(1, 10 * STEPS))
    return math.exp(log_front) / _fraction(half + 1.0 - a, terms)


def _pairwise(function):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            None if pd.isna(x) or pd.isna(y) else function(float(x), float(y)) for x, y in zip(a, b)
        ], dtype="float64")

    return over


def correlation_p_column(r, n):
    return F.pandas_udf(_pairwise(correlation_p), "double")(r, n)


def chi2_p_column(x, df):
    return F.pandas_udf(_pairwise(chi2_upper), "double")(x, df)


def normal_p_column(z):
    return F.pandas_udf(_pairwise(lambda a, _: normal_two_sided(a)), "double")(z, z)
