"""Arrays of doubles as vectors: all inside code generation or array functions, never exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(z: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.transform(z, lambda x: x / t)


def log_sum_exp(z: Column) -> Column:
    """Stable: the greatest is taken out first."""
    top = F.array_max(z)
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(z: Column) -> Column:
    lse = log_sum_exp(z)
    return F.transform(z, lambda x: F.exp(x - lse))


def log_softmax(z: Column) -> Column:
    lse = log_sum_exp(z)
    return F.transform(z, lambda x: x - lse)


def first_argmax(z: Column) -> Column:
    """Place, from zero, of the first greatest."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def nll(z: Column, gold: Column) -> Column:
    """-ln of the softmax share of place ``gold``."""
    return log_sum_exp(z) - F.get(z, gold)


def brier(p: Column, gold: Column) -> Column:
    """Sum over classes of (p - one-hot) squared."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda a, x: a + x)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    """Greatest minus second greatest; the greatest itself of one."""
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def geometric_grid(low: float, high: float, n: int) -> Column:
    ratio = high / low
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) * F.pow(F.lit(ratio), i / F.lit(float(n - 1))))


def digitize(x: Column, edges: Column) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(edges, lambda e: e <= x))
