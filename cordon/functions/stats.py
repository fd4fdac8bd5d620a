"""Regression statistics as plain Spark column expressions.

Spark has no Student-t distribution function. For the integer degrees of
freedom a regression produces, the two-sided central probability has a finite
closed form (Abramowitz & Stegun 26.7.3 for odd, 26.7.4 for even df):

    theta = atan(|t| / sqrt(df)),  c = cos(theta),  s = sin(theta)
    even df: A = s * sum_{k=0}^{(df-2)/2} a_k,   a_0 = 1, a_k = a_{k-1} (2k-1)/(2k) c^2
    odd df:  A = 2/pi * (theta + s * sum_{k=0}^{(df-3)/2} b_k),  b_0 = c,
             b_k = b_{k-1} (2k)/(2k+1) c^2   (df = 1: A = 2 theta / pi)
    p = 1 - A

``1 - A`` cancels when p is small, so below ``_SMALL`` the tail itself is summed
(Abramowitz & Stegun 26.5.4, all terms positive), with x = df / (df + t^2), a = df / 2:

    p = x^a (1-x)^(1/2) / (a B(a, 1/2)) * sum_{n >= 0} prod_{k < n} (a + 1/2 + k) / (a + 1 + k) * x^n

Each term is under x times the one before, so 45 / (1 - x) terms reach double precision.
``B(a, 1/2)`` follows from B(1, 1/2) = 2 or B(1/2, 1/2) = pi by B(a+1, 1/2) = B(a, 1/2) a / (a + 1/2).

The series is evaluated with ``aggregate`` over ``sequence`` so it stays a
JVM expression on the (single) statistics row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# scipy.stats.linregress guards r = +-1 with this constant.
_TINY = 1.0e-20
# Below this p the tail is summed directly.
_SMALL = 1.0e-3


def _series(n_terms: Column, first: Column, ratio, c2: Column) -> Column:
    """Sum of a_0..a_{n_terms-1} with a_0 = first, a_k = a_{k-1} * ratio(k) * c2."""
    ks = F.filter(F.sequence(F.lit(1), F.greatest(n_terms - 1, F.lit(1))),
                  lambda k: k < n_terms)
    init = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))

    def step(acc, k):
        term = acc.getField("term") * ratio(k.cast("double")) * c2
        return F.struct(term.alias("term"), (acc.getField("total") + term).alias("total"))

    return F.aggregate(ks, init, step).getField("total")


def _tail(t2: Column, df: Column, wanted: Column) -> Column:
    """The two-sided tail for small p, as a sum of positive terms (one term where it isn't wanted)."""
    a, x, y = df / 2, df / (df + t2), t2 / (df + t2)
    start = F.when(df % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    steps = F.sequence(F.lit(0), F.greatest(F.floor(a - start).cast("int"), F.lit(0)))
    log_beta = F.when(df % 2 == 0, F.lit(math.log(2.0))).otherwise(F.lit(math.log(math.pi))) + F.aggregate(
        F.filter(steps, lambda k: k < F.floor(a - start)), F.lit(0.0),
        lambda s, k: s + F.log((start + k) / (start + k + 0.5)))
    n = F.when(wanted, F.least(F.ceil(45.0 / y), F.lit(1_000_000)).cast("int")).otherwise(F.lit(0))
    total = F.aggregate(
        F.sequence(F.lit(0), n), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * x * (a + 0.5 + k) / (a + 1 + k)).alias("term"),
                              (s["sum"] + s["term"] * x * (a + 0.5 + k) / (a + 1 + k)).alias("sum")))["sum"]
    return F.exp(a * F.log(x) + 0.5 * F.log(y) - F.log(a) - log_beta) * total


def t_two_sided_p(t, df) -> Column:
    """Two-sided p-value of Student's t with integer `df` (null when df < 1)."""
    t = F.col(t) if isinstance(t, str) else t
    df = (F.col(df) if isinstance(df, str) else df).cast("int")
    dfd = df.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(dfd))
    c, s = F.cos(theta), F.sin(theta)
    c2 = c * c
    even_a = s * _series(F.floor((df - 2) / 2).cast("int") + 1, F.lit(1.0), lambda k: (2 * k - 1) / (2 * k), c2)
    odd_a = F.lit(2.0 / math.pi) * (
        theta + s * _series(F.floor((df - 3) / 2).cast("int") + 1, c, lambda k: (2 * k) / (2 * k + 1), c2))
    a = (F.when(df % 2 == 0, even_a)
         .when(df == 1, F.lit(2.0 / math.pi) * theta)
         .otherwise(odd_a))
    p = F.lit(1.0) - a
    return F.when(df >= 1, F.when(p < _SMALL, _tail(t * t, dfd, p < _SMALL)).otherwise(p))


def t_statistic(r, df) -> Column:
    """t of a correlation r with df degrees of freedom, as scipy computes it."""
    r = F.col(r) if isinstance(r, str) else r
    df = (F.col(df) if isinstance(df, str) else df).cast("double")
    return r * F.sqrt(df / ((F.lit(1.0) - r + F.lit(_TINY)) * (F.lit(1.0) + r + F.lit(_TINY))))


def regression_p_value(r, n) -> Column:
    """p-value of the OLS slope for n pairs with correlation r (null for n < 3)."""
    n = F.col(n) if isinstance(n, str) else n
    df = (n - 2).cast("int")
    return F.when(n >= 3, t_two_sided_p(t_statistic(r, df), df))
