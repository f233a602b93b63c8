"""Two models on the same items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.95996398454


def aligned(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Inner join of two arms, other columns with the suffixes _a and _b."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return left.join(right, key)


def alignment(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(in_both, only_a, only_b): whether both sides hold the same keys."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    return j.agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
    )


def quadrants(a_ok: Column, b_ok: Column) -> list[Column]:
    return [
        F.count_if(a_ok & b_ok).alias("both_right"),
        F.count_if(~a_ok & ~b_ok).alias("both_wrong"),
        F.count_if(a_ok & ~b_ok).alias("only_a"),
        F.count_if(~a_ok & b_ok).alias("only_b"),
    ]


def log_factorial(n: Column) -> Column:
    """ln n!, by the sum below 32 and Stirling's series above, to about 1e-14 relative."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * F.pow(x, F.lit(5))) - 1.0 / (1680.0 * F.pow(x, F.lit(7)))
    return F.when(n <= 32, small).otherwise(series)


#: Terms summed at most, and the number of discordant pairs up to which these are all that count.
TERMS, MOST_EXACT = 4_000, 400_000


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by a rational series, relative error about 1e-7."""
    t = 1.0 / (1.0 + 0.5 * x)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)  # fixed values: a published fit
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + F.lit(k)
    return t * F.exp(-x * x + poly)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs, in logarithms so that tiny p survive.

    The tail is summed from its greatest term on, each from the one before, TERMS of them at most; with MOST_EXACT pairs or
    fewer, what is beyond is under 1e-17 of the sum. Beyond that the normal tail with continuity
    correction is exact to about one part in a thousand wherever p is not itself negligible.
    """
    n, k = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    def add(acc: Column, j: Column) -> Column:
        term = F.when(j == 0, 1.0).otherwise(acc["term"] * (k - j + 1) / (n - k + j))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    whole = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(k, F.lit(TERMS))), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), add, lambda acc: acc["total"])
    tail = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0)) + F.log(whole)
    z = F.greatest((F.abs(b - c) - 1).cast("double"), F.lit(0.0)) / F.sqrt(n.cast("double"))
    return F.when(n == 0, 1.0).when(n > MOST_EXACT, erfc(z / math.sqrt(2))).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(tail)))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """With continuity correction; 0 without discordant pairs."""
    d = F.abs(b - c) - 1
    return F.coalesce(F.try_divide((d * d).cast("double"), (b + c).cast("double")), F.lit(0.0))


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """A bound of the 95 % interval of k of n; null for n = 0."""
    n_, p, z2 = n.cast("double"), F.try_divide(k.cast("double"), n.cast("double")), F.lit(Z95 * Z95)
    mid, half = p + z2 / (2 * n_), Z95 * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_))
    return F.when(n > 0, (mid + half if upper else mid - half) / (1 + z2 / n_))
