"""Running sums and row numbers over groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans.lineage import partitions, written


def with_prefix_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, per name, ``name_before`` (the sum over earlier rows of the group) and ``name_all``.

    Rows are range-partitioned by group and order and written once; each partition sums within
    itself and adds what the partitions before it hold for the group, which is one small row per
    partition and group. A group that is a third of all rows is spread over a third of the tasks.
    """
    spark = rows.sparkSession
    value = {k: f"__{k}__" for k in sums}
    valued = rows.select("*", *[c.alias(value[k]) for k, c in sums.items()])
    ranged = valued.repartitionByRange(partitions(spark), *map(F.col, by), *order)
    rows_ = written(ranged.withColumn("__part__", F.spark_partition_id()), "prefix")
    per = rows_.groupBy("__part__", *by).agg(*[F.sum(v).alias(v) for v in value.values()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("__part__").alias("__of__"), *[F.col(b).alias(f"__of_{b}__") for b in by], *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}off") for v in value.values()], *[F.sum(v).over(group).alias(f"{k}_all") for k, v in value.items()])
    local = Window.partitionBy("__part__", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows_.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"{v}loc") for v in value.values()])
    same = F.col("__part__") == F.col("__of__")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__of_{b}__"))
    joined = summed.join(offsets, same)
    return joined.select(*rows.columns, *[(F.col(f"{v}loc") + F.col(f"{v}off")).alias(f"{k}_before") for k, v in value.items()], *[f"{k}_all" for k in sums])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn", total: str = "n") -> DataFrame:
    """rows with their number from 1 within the group, and how many the group has; order must be total."""
    out = with_prefix_sums(rows, by, order, {"__one": F.lit(1).cast("bigint")})
    return out.select(*rows.columns, (F.col("__one_before") + 1).alias(name), F.col("__one_all").alias(total))
