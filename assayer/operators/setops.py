"""Set comparison of keys: leaks, coverage, drift, conservation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_left, n_right, n_null_left, n_null_right, n_common) of distinct keys.

    A check over keys that are not there must not read as passed, so what was compared is counted too.
    """
    tag = lambda d, s: d.select(F.col(key).alias("k"), F.lit(s).alias("side"))
    both = tag(a, "a").unionByName(tag(b, "b"))
    per = both.groupBy("k").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    has, a_, b_ = F.col("k").isNotNull(), F.col("a") > 0, F.col("b") > 0
    return per.agg(
        F.count_if(has & a_).alias("n_left"),
        F.count_if(has & b_).alias("n_right"),
        F.coalesce(F.sum(F.when(~has, F.col("a"))), F.lit(0)).alias("n_null_left"),
        F.coalesce(F.sum(F.when(~has, F.col("b"))), F.lit(0)).alias("n_null_right"),
        F.count_if(has & a_ & b_).alias("n_common"),
    )


def sides(rows: DataFrame, key: str, side: str) -> DataFrame:
    """(side_a, side_b, n_common) for each pair of sides that share a key, each side with itself too.

    Per key the set of its sides is built (as many entries as there are sides), so keys with many rows
    are not squared.
    """
    per = rows.where(F.col(key).isNotNull() & F.col(side).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(side)).alias("s"))
    pairs = per.select(F.explode("s").alias("side_a"), "s").select("side_a", F.explode("s").alias("side_b")).where("side_a <= side_b")
    return pairs.groupBy("side_a", "side_b").agg(F.count(F.lit(1)).alias("n_common"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the symmetric difference."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.subtract(y).withColumn("side", F.lit("left")).unionByName(y.subtract(x).withColumn("side", F.lit("right")))


def conserved(parent: DataFrame, children: Sequence[DataFrame], key: str) -> DataFrame:
    """(n_parent, n_children, n_shared, n_lost, n_foreign): whether children split the parent by key."""
    parts = reduce(DataFrame.unionByName, [c.select(key).distinct().withColumn("part", F.lit(i)) for i, c in enumerate(children)])
    per = parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts"))
    j = parent.select(key).distinct().withColumn("here", F.lit(1)).join(per, key, "full_outer")
    return j.agg(
        F.count("here").alias("n_parent"),
        F.count("parts").alias("n_children"),
        F.count_if(F.col("parts") > 1).alias("n_shared"),
        F.count_if(F.col("parts").isNull()).alias("n_lost"),
        F.count_if(F.col("here").isNull()).alias("n_foreign"),
    )


def digest(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, digest): order-free content digest of the distinct values.

    Digits of the values' SHA-256 are summed, which combines before the shuffle and needs no list.
    """
    distinct = rows.where(F.col(value).isNotNull()).select(*by, value).distinct()
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(F.col(value).cast("string"), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    out = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[part(i).alias(f"d{i}") for i in range(4)])
    return out.select(*by, "n", F.concat_ws("-", *[F.col(f"d{i}").cast("string") for i in range(4)]).alias("digest"))
