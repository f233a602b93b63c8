"""Samples and splits that follow from a seed: hash ranks, not a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans.prefix import numbered


def rank_key(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def sample(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows with the smallest hash ranks; a top-k, never a full sort."""
    return rows.orderBy(rank_key(seed, key), key).limit(n)


def sample_per(rows: DataFrame, by: Sequence[str], n: int, seed: str, key: str) -> DataFrame:
    """n rows per cell by hash rank."""
    w = Window.partitionBy(*by).orderBy(rank_key(seed, key), key)
    return rows.withColumn("__rank__", F.row_number().over(w)).where(F.col("__rank__") <= n).drop("__rank__")


def holdout_groups(rows: DataFrame, source: str, group: str, share: float, seed: str) -> DataFrame:
    """(source, group): per source max(1, half-even round of groups x share) whole groups, by hash rank."""
    groups = rows.where(F.col(group).isNotNull()).select(source, group).distinct()
    ranked = numbered(groups.withColumn("__rank__", rank_key(seed, source, group)), [source], [F.col("__rank__").asc(), F.col(group).asc()])
    return ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).select(source, group)


def split_by_groups(rows: DataFrame, source: str, group: str, share: float, seed: str) -> DataFrame:
    """rows with ``held``: whether their whole group was held out; rows without a group are not."""
    held = holdout_groups(rows, source, group, share, seed).withColumn("held", F.lit(True))
    return rows.join(held, [source, group], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def sequential_quotas(rows: DataFrame, pool: str, group: str, quotas: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """(pool, group, split): groups dealt to splits one after another, none twice.

    One rank per pool, cut at the cumulative quotas, takes the place of drawing and removing in turn.
    """
    groups = rows.where(F.col(group).isNotNull()).select(pool, group).distinct()
    ranked = groups.withColumn("rn", F.row_number().over(Window.partitionBy(pool).orderBy(rank_key(seed, pool, group), group)))
    split, upto = F.lit(None).cast("string"), 0
    for name, n in quotas:
        split = F.when((F.col("rn") > upto) & (F.col("rn") <= upto + n), name).otherwise(split)
        upto += n
    return ranked.where(F.col("rn") <= upto).select(pool, group, split.alias("split"))


def round_robin(rows: DataFrame, topic: str, order: Sequence[Column], seed: str) -> DataFrame:
    """rows with ``turn`` and ``place``: the first of each topic, then the second of each, topics in hash order."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(topic).orderBy(*order)))
    return ranked.withColumn("place", rank_key(seed, topic))


def balanced(rows: DataFrame, label: str, n: int, seed: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """n rows of each cell of ``by`` (of all without any), labels in turn, each label's rows by hash rank."""
    w = Window.partitionBy(*by, label).orderBy(rank_key(seed, key), key)
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    if not by:
        return ranked.orderBy("turn", label).limit(n).drop("turn")
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("turn", label)))  # n rows a label at most
    return placed.where(F.col("place") <= n).drop("turn", "place")
