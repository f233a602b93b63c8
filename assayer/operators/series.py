"""Step series: sums per step, windows, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_sums(rows: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    return rows.groupBy(run, step).agg(F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("parts"))


def last_mean(rows: DataFrame, run: str, step: str, loss: str, n: int) -> DataFrame:
    """(run, n_steps, last_mean): mean of the last n step sums, null if there are fewer."""
    ranked = step_sums(rows, run, step, loss).withColumn("rn", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step))))
    kept = ranked.where(F.col("rn") <= n)
    return kept.groupBy(run).agg(F.count(F.lit(1)).alias("n_steps"), F.when(F.count(F.lit(1)) == n, F.avg("loss")).alias("last_mean"))


def rolling_mean(rows: DataFrame, run: str, step: str, loss: str, n: int) -> DataFrame:
    w = Window.partitionBy(run).orderBy(step).rowsBetween(1 - n, 0)
    s = step_sums(rows, run, step, loss)
    return s.select(run, step, F.when(F.count(F.lit(1)).over(w) == n, F.avg("loss").over(w)).alias("rolling"))


def validity(rows: DataFrame, run: str, step: str, loss: str, per_step: int) -> DataFrame:
    """(run, gaps, uneven, not_finite): what is wrong with each series."""
    s = step_sums(rows, run, step, loss)
    gap = F.col(step) - F.lag(step).over(Window.partitionBy(run).orderBy(step)) != 1
    finite = ~F.isnan("loss") & (F.abs("loss") != F.lit(float("inf")))
    return s.select(run, gap.alias("gap"), (F.col("parts") != per_step).alias("uneven"), (~finite).alias("bad")).groupBy(run).agg(
        F.count_if("gap").alias("gaps"), F.count_if("uneven").alias("uneven"), F.count_if("bad").alias("not_finite")
    )
