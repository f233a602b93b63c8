"""Exact ranks by range-partitioned sorting with partition offsets.

Equal values are first counted per group and statistic, so a value that a third of all texts share
is one row. The distinct values are range-partitioned, sorted inside their partition and written;
a partition's running count starts from what the partitions before it hold (one small row per
partition, statistic and group). No partition ever sees the whole column and nothing is sorted twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans.lineage import partitions, written


def long_form(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, stat, value): a row per statistic, as doubles; nulls are left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in columns])
    out = rows.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.stat", "p.value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


#: The group that all rows belong to besides their own.
WHOLE = "*"


def tails(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, stat, value, n, low, high): mid-ranks, the shares of the group's rows below and above a value, equal ones counting half.

    The group WHOLE holds the ranks among all rows.
    """
    counts = long_form(rows, [group], columns).groupBy(group, "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "ranks-counts")
    counts = counts.unionByName(counts.groupBy("stat", "value").agg(F.sum("n").alias("n")).select(F.lit(WHOLE).alias(group), "stat", "value", "n"))
    kind = rows.schema[group].dataType.simpleString()
    order = ["stat", group, "value"]

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, 0
        for pdf in batches:
            out = []
            for g, s, n in zip(pdf[group], pdf["stat"], pdf["n"], strict=True):
                carried = carried + n if (g, s) == last else n
                last = (g, s)
                out.append(carried)
            yield pdf.assign(local=out)

    ranged = counts.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    local = ranged.mapInPandas(running, f"{group} {kind}, stat string, value double, n long, local long")
    local = written(local.withColumn("part", F.spark_partition_id()), "ranks-local")
    per = local.groupBy("part", group, "stat").agg(F.sum("n").alias("held"))
    before = Window.partitionBy(group, "stat").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group, "stat")
    offsets = per.select("part", group, "stat", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(whole).alias("total"))
    upto = F.col("local") + F.col("offset")
    found = local.join(F.broadcast(offsets), ["part", group, "stat"])  # at most partitions x groups x statistics
    below = (upto - F.col("n") / 2) / F.col("total")
    return found.select(group, "stat", "value", "n", below.alias("low"), (1 - below).alias("high"))
