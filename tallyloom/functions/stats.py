"""Statistics that Spark lacks, over small aggregates, and named test variants."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Normal quantiles of the interval and of 80 % power, the target effect.
Z_975, Z_80, EFFECT = 1.960, 0.842, 0.05
#: Up to so many trials a tail is summed in exact integers, up to so many degrees of freedom Student's sums are taken.
EXACT = 1000


def student_cdf(t: float, df: int) -> float:
    """P(T <= t) for whole degrees of freedom, by the finite trigonometric sums."""
    angle = math.atan2(t, math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    if df % 2:
        term, total = c, 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 0.5 + (angle + s * total) / math.pi
    term, total = 1.0, 0.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 0.5 + s * total / 2


def student_quantile(p: float, df: int) -> float:
    """The t with student_cdf(t, df) = p, NaN below one degree of freedom. Of many
    degrees by the expansion around the normal quantile, whose next term is below 1e-11."""
    if df < 1:
        return math.nan
    if df > EXACT:
        z = NormalDist().inv_cdf(p)
        terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
        return z + sum(x / df**i for i, x in enumerate(terms, 1))
    low, high = 0.0, 1.0
    while student_cdf(high, df) < p:
        low, high = high, 2 * high
    while high - low > 1e-12 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if student_cdf(middle, df) < p else (low, middle)
    return high


def _stirling_error(n: int) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _just(wins: int, trials: int) -> float:
    """P(X = wins) of a fair coin, by its deviance from an even split (Loader's saddle point)."""
    if wins in (0, trials):
        return math.ldexp(1.0, -trials)
    x = (2 * wins - trials) / trials
    deviance = trials / 2 * ((1 + x) * math.log1p(x) + (1 - x) * math.log1p(-x))
    error = _stirling_error(trials) - _stirling_error(wins) - _stirling_error(trials - wins)
    return math.sqrt(trials / (2 * math.pi * wins * (trials - wins))) * math.exp(error - deviance)


def tail_at_least(wins: int, trials: int) -> float:
    """P(X >= wins) of a fair coin: in exact integers for few trials, else from
    the first term by the ratio of neighbouring ones, until none counts."""
    if trials <= EXACT:
        return sum(math.comb(trials, k) for k in range(wins, trials + 1)) / 2**trials
    if wins > trials:
        return 0.0
    if 2 * wins <= trials:
        return 1.0 - tail_at_least(trials - wins + 1, trials)
    term = total = 1.0
    k = wins
    while k < trials and term > 1e-18 * total:
        term *= (trials - k) / (k + 1)
        total += term
        k += 1
    return _just(wins, trials) * total


@F.pandas_udf(T.DoubleType())
def t_exact(df: pd.Series) -> pd.Series:
    """The 0.975 quantile to four places."""
    return df.map(lambda n: None if n is None or pd.isna(n) else round(student_quantile(0.975, int(n)), 4))


@F.pandas_udf(T.DoubleType())
def t_table(df: pd.Series) -> pd.Series:
    """As ``t_exact`` at the next smaller of 1-30, 40, 60, 80, 100, 120 degrees."""
    steps = [*range(1, 31), 40, 60, 80, 100, 120]
    return df.map(lambda n: None if n is None or pd.isna(n) or n < 1 else round(student_quantile(0.975, max(s for s in steps if s <= n)), 3))


@F.pandas_udf(T.DoubleType())
def sign_two_sided(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """min(1, 2 P(X <= the fewer)); null without trials."""
    return pd.Series([None if w + x == 0 else min(1.0, 2 * tail_at_least(int(max(w, x)), int(w + x))) for w, x in zip(wins, losses, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sign_one_sided(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """P(X >= wins); 1 without trials."""
    return pd.Series([1.0 if w + x == 0 else tail_at_least(int(w), int(w + x)) for w, x in zip(wins, losses, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))


def wins(delta: Column, tolerance: float) -> Column:
    return F.count_if(delta > tolerance)


def losses(delta: Column, tolerance: float) -> Column:
    return F.count_if(delta < -tolerance)


def spread(x: Column) -> Column:
    """Sample deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def detectable(sd: Column, n: Column) -> Column:
    return F.lit(Z_975 + Z_80) * sd / F.sqrt(n)


def required(sd: Column) -> Column:
    return F.ceil(F.pow(F.lit(Z_975 + Z_80) * sd / F.lit(EFFECT), 2.0))


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    by = partition or []
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2
