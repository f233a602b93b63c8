"""Bootstrap over whole families.

Rows are first summed per family (partial aggregation, one small row each). ``replicate_sums`` then
weights families by independent Poisson(1) counts, replicate by replicate, and adds up weighted
sums where the families lie: what is shuffled is one row per task and replicate, whatever the number
of families. A weight is a function of seed, replicate and family, so it does not depend on the
layout. Statistics that follow from sums (means, differences of paired means, calibration error from
sums per bin) are computed from the sums of each replicate.

``draws`` gives the exact scheme (as many draws as families, with replacement) from a counter hash
that any engine reproduces; its size is replicates x families, so it is for small tables and checks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import number_of
from assayer.plans.prefix import numbered


def families(rows: DataFrame, by: Sequence[str], group: str, values: dict[str, Column]) -> DataFrame:
    """(by, gi, n_groups, group, sums..., n): one row per family, numbered from 0 within ``by`` in order of group."""
    per = rows.groupBy(*by, group).agg(*[F.sum(c).alias(k) for k, c in values.items()], F.count(F.lit(1)).alias("n"))
    out = numbered(per, by, [F.col(group).asc()], "gi", "n_groups")
    return out.select(*by, (F.col("gi") - 1).cast("int").alias("gi"), "n_groups", group, *values, "n")


def draws(fam: DataFrame, by: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(by, b, gi, weight): how often replicate b drew family gi."""
    sizes = fam.groupBy(*by).agg(F.max("n_groups").alias("g"))
    cells = sizes.select(*by, "g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    cells = cells.select(*by, "g", "b", F.explode(F.sequence(F.lit(0), (F.col("g") - 1).cast("int"))).alias("j"))
    drawn = cells.select(*by, "b", F.pmod(number_of(seed, F.col("b").cast("string"), F.col("j").cast("string")), F.col("g")).cast("int").alias("gi"))
    return drawn.groupBy(*by, "b", "gi").agg(F.count(F.lit(1)).alias("weight"))


def replicates_of_ratio(fam: DataFrame, by: Sequence[str], total: str, replicates: int, seed: str) -> DataFrame:
    """(by, b, m): in each replicate the sum of ``total`` over the sum of n."""
    j = fam.join(draws(fam, by, replicates, seed), [*by, "gi"])
    return j.groupBy(*by, "b").agg((F.sum(F.col(total) * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))


def interval(reps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lo, hi): linear percentiles 2.5 and 97.5."""
    return reps.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def interval_nearest_rank(reps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lo, hi): sorted[int(q * B)] of the replicates."""
    s = F.array_sort(F.collect_list("m"))  # one number per replicate
    at = lambda q: F.element_at(s, F.least(F.floor(q * F.count(F.lit(1))), F.count(F.lit(1)) - 1).cast("int") + 1)
    return reps.groupBy(*by).agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


#: Replicates that intervals are taken from.
REPLICATES = 10_000
_BLOCK = 1 << 20  # weights held at a time


def poisson_table() -> np.ndarray:
    """Poisson(1) counts of 16-bit numbers: each count as often as its probability says, and their mean 1."""
    edges = np.floor(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]) * 65536 + 0.5).astype(int)
    out = np.searchsorted(edges, np.arange(65536), side="right")
    out[65536 - abs(65536 - int(out.sum())) :] += np.sign(65536 - int(out.sum()))  # what rounding took from the mean
    return out.astype(np.float64)


def weights(families: np.ndarray, replicates: int) -> np.ndarray:
    """(families x replicates) Poisson(1) weights from 64-bit family hashes: four weights of each mixed counter."""
    n = -(-replicates // 4)
    x = families.view(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return _TABLE[x.view(np.uint16)[:, :replicates]]


_TABLE = poisson_table()


def replicate_sums(rows: DataFrame, by: Sequence[str], group: str, values: dict[str, Column], replicates: int = REPLICATES, seed: str = "b") -> DataFrame:
    """(by, b, values..., n): weighted sums in each replicate b, n being the weighted number of rows."""
    fam = rows.groupBy(*by, group).agg(*[F.sum(c).cast("double").alias(k) for k, c in values.items()], F.count(F.lit(1)).cast("double").alias("n"))
    names = [*values, "n"]
    hashed = fam.select(*by, F.xxhash64(F.lit(seed), F.col(group).cast("string")).alias("__h"), *names)
    kinds = ", ".join(f"{c} {t}" for c, t in hashed.select(*by).dtypes)
    step = max(1, _BLOCK // replicates)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for key, total in sums.items():
                yield pd.DataFrame(dict(zip(by, key, strict=True)) | {"b": np.arange(replicates, dtype=np.int32)} | dict(zip(names, total, strict=True)))

        for pdf in batches:
            for key, mine in pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]:
                v, h = mine[names].fillna(0.0).to_numpy(np.float64).T, mine["__h"].to_numpy(np.int64)
                total = sums.setdefault(key, np.zeros((len(names), replicates)))
                for i in range(0, len(h), step):
                    total += v[:, i : i + step] @ weights(h[i : i + step], replicates)
            if len(sums) > 200:
                yield from told()
                sums.clear()
        yield from told()

    part = hashed.mapInPandas(of, f"{kinds}{', ' if by else ''}b int, {', '.join(f'{k} double' for k in names)}")
    return part.groupBy(*by, "b").agg(*[F.sum(k).alias(k) for k in names])


def replicates_of_mean(rows: DataFrame, by: Sequence[str], group: str, value: Column, replicates: int = REPLICATES, seed: str = "b") -> DataFrame:
    """(by, b, m): the mean of value in each replicate."""
    return replicate_sums(rows, by, group, {"s": value}, replicates, seed).select(*by, "b", F.try_divide("s", "n").alias("m"))


def replicates_of_ece(rows: DataFrame, by: Sequence[str], group: str, bin_: Column, ok: Column, conf: Column, bins: int, replicates: int = REPLICATES, seed: str = "b") -> DataFrame:
    """(by, b, m): the expected calibration error in each replicate, from the sums of each bin."""
    gap = {f"g{k}": F.when(bin_ == k, ok - conf).otherwise(0.0) for k in range(bins)}
    sums = replicate_sums(rows, by, group, gap, replicates, seed)
    return sums.select(*by, "b", F.try_divide(sum((F.abs(F.col(k)) for k in gap), F.lit(0.0)), F.col("n")).alias("m"))


def bootstrap_mean(rows: DataFrame, by: Sequence[str], group: str, value: Column, replicates: int = REPLICATES, seed: str = "b") -> DataFrame:
    """(by, point, lo, hi, n_groups, degenerate): the mean, its 95 % interval, the number of families."""
    whole = rows.groupBy(*by).agg(F.avg(value).alias("point"), F.count_distinct(F.col(group)).alias("n_groups"))
    ci = interval(replicates_of_mean(rows, by, group, value, replicates, seed), by)
    return whole.join(ci, list(by)).select(*by, "point", "lo", "hi", "n_groups", (F.col("lo") == F.col("hi")).alias("degenerate"))
