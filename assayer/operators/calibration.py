"""Confidence: items, calibration error, temperature, selective accuracy, rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import vectors as V
from assayer.plans.prefix import numbered, with_prefix_sums

BINS = 15
COVERAGES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0)


def items(scores: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """scores with pred, correct, pmax, nll and brier of each row at a temperature; one projection."""
    z = V.scaled(F.col("z"), temperature)
    rows = scores.withColumn("__z__", z).withColumn("__p__", V.softmax(F.col("__z__")))
    rows = rows.withColumn("pred", V.first_argmax(F.col("__z__")))
    return rows.select(
        *scores.columns,
        "pred",
        (F.col("pred") == F.col("gold")).cast("int").alias("correct"),
        F.array_max("__p__").alias("pmax"),
        V.nll(F.col("__z__"), F.col("gold")).alias("nll"),
        V.brier(F.col("__p__"), F.col("gold")).alias("brier"),
    )


def bin_of(p: Column, bins: int = BINS) -> Column:
    """Right-open bins of equal width; 1 belongs to the last. Edges are counted, not computed from p."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return V.digitize(p, edges)


def ece(rows: DataFrame, by: Sequence[str], p: str = "pmax", ok: str = "correct", bins: int = BINS) -> DataFrame:
    """(by, ece): weighted gap of accuracy and confidence over bins."""
    cells = rows.groupBy(*by, bin_of(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("ok"), F.sum(p).alias("conf"))
    gap = F.abs(F.col("ok") / F.col("n") - F.col("conf") / F.col("n")) * F.col("n")
    return cells.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, accuracy, nll, brier, mean_pmax, ece) of items."""
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("pmax").alias("mean_pmax"))
    return plain.join(ece(rows, by), list(by))


def temperature_fit(scores: DataFrame, by: Sequence[str], low: float = 0.05, high: float = 20.0, points: int = 4001, step: int = 64) -> DataFrame:
    """(by, temperature, nll, at_boundary): the grid point of least mean NLL; ties take the smallest.

    Mean NLL is convex in 1 / T, so the best grid point lies between the neighbours of the best of
    every ``step``-th point. Two passes over points / step and 2 * step points replace one over all.
    """
    grid = grid_with_one(low, high, points)
    coarse = sorted({*range(0, len(grid), step), len(grid) - 1})
    slots = F.array(*map(F.lit, coarse))
    first = _best_slot(scores.select(*by, "z", "gold", F.explode(slots).alias("slot")), by, grid)
    near = scores.join(F.broadcast(first.select(*by, F.col("slot").alias("at"))), list(by))  # one row per group of ``by``
    fine = F.sequence(F.greatest(F.lit(0), F.col("at") - step), F.least(F.lit(len(grid) - 1), F.col("at") + step))
    best = _best_slot(near.select(*by, "z", "gold", F.explode(fine).alias("slot")), by, grid)
    return best.select(*by, "temperature", "nll", F.col("slot").isin(0, len(grid) - 1).alias("at_boundary"))


def argmax_moved(scores: DataFrame, by: Sequence[str], temperature: Column) -> DataFrame:
    """(by, n, moved): rows whose prediction differs after scaling by a temperature."""
    moved = V.first_argmax(V.scaled(F.col("z"), temperature)) != V.first_argmax(F.col("z"))
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("moved"))


def _best_slot(rows: DataFrame, by: Sequence[str], grid: list[float]) -> DataFrame:
    t = F.get(F.expr(f"array({', '.join(f'{x!r}D' for x in grid)})"), F.col("slot"))  # one call, not one a point
    per = rows.withColumn("t", t).groupBy(*by, "slot", "t").agg(F.avg(V.nll(V.scaled(F.col("z"), F.col("t")), F.col("gold"))).alias("nll"))
    best = per.groupBy(*by).agg(F.min(F.struct("nll", "t", "slot")).alias("b"))
    return best.select(*by, F.col("b.slot").alias("slot"), F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def grid_with_one(low: float, high: float, points: int) -> list[float]:
    ratio = high / low
    return sorted({low * ratio ** (i / (points - 1)) for i in range(points)} | {1.0})


def selective(rows: DataFrame, by: Sequence[str], coverages: Sequence[float] = COVERAGES, pos: str = "id") -> DataFrame:
    """(by, coverage, k, accuracy): accuracy of the k = ceil(coverage x n) most confident rows, ties in order of pos."""
    ranked = numbered(rows.select(*by, "correct", "pmax", pos), by, [F.desc("pmax"), F.col(pos).asc()])
    k = [F.ceil(F.lit(c) * F.col("n")) for c in coverages]
    wanted = ranked.select(*by, "correct", "rn", F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), x.alias("k")) for c, x in zip(coverages, k, strict=True)])).alias("c"))
    return wanted.where(F.col("rn") <= F.col("c.k")).groupBy(*by, "c.coverage", "c.k").agg(F.avg("correct").alias("accuracy"))


def auc(rows: DataFrame, by: Sequence[str], score: str, ok: str) -> DataFrame:
    """(by, auc, n): Mann-Whitney by average ranks, ties one half; null if a class is missing.

    Equal scores are counted together before they are ordered.
    """
    values = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok).cast("boolean")).alias("pos"))
    running = with_prefix_sums(values, by, [F.col(score).asc()], {"n": F.col("n")})
    ranks = running.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
    sums = ranks.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum("n").alias("n"))
    return sums.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * F.col("q")).cast("double")).alias("auc"), "n")


def banded(rows: DataFrame, by: Sequence[str], value: str, ok: str, edges: Sequence[float]) -> DataFrame:
    """(by, band, n, mean_value, accuracy) for lower <= value < upper of neighbouring edges; outside is left out."""
    band = V.digitize(F.col(value), F.array(*[F.lit(float(e)) for e in edges])) - 1
    inside = rows.withColumn("band", band).where((F.col("band") >= 0) & (F.col("band") < len(edges) - 1))
    return inside.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.avg(F.col(ok).cast("int")).alias("accuracy"))
