"""One row per key, and keys with more than one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; limited per key before the shuffle, so hot keys cost little."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank__", rank).where(F.col("__rank__") == 1).drop("__rank__")


def repeated(rows: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def first_content(rows: DataFrame, content: Column, order: Sequence[Column]) -> DataFrame:
    """Exact content duplicates removed, first wins; rows without content pass."""
    keyed = rows.withColumn("__content__", content)
    kept = first_by(keyed.where(F.col("__content__").isNotNull()), ["__content__"], order)
    return kept.unionByName(keyed.where(F.col("__content__").isNull())).drop("__content__")


def compacted(log: DataFrame, key: str = "id", judged: str = "correct", pos: str = "log_pos") -> DataFrame:
    """An answer log, one row per key: the last judged row, else the first unjudged one."""
    from assayer.operators.exactly_once import judged_first

    return first_by(log, [key], judged_first(judged, pos))
