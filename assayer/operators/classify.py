"""Confusion, F1 and recall over a fixed set of classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_grid(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    one = spark.createDataFrame([(x,) for x in labels], "gold string")
    return one.select("gold", F.explode(F.array(*map(F.lit, labels))).alias("pred"))


def confusion(rows: DataFrame, labels: Sequence[str], gold: str, pred: str) -> DataFrame:
    """(gold, pred, n) of every pair of the given labels, also those that never occur."""
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = label_grid(rows.sparkSession, labels)
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def per_class(rows: DataFrame, labels: Sequence[str], gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, n_true, n_pred, recall, f1); recall null without rows, F1 then 0."""
    each = F.array(*map(F.lit, labels))
    counts = rows.groupBy(*by, gold, pred).agg(F.count(F.lit(1)).alias("n"))  # partial counts first; then at most labels squared
    spread = counts.withColumn("label", F.explode(each))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    is_gold, is_pred = F.col(gold) == F.col("label"), F.col(pred) == F.col("label")
    out = spread.groupBy(*by, "label").agg(n(is_gold & is_pred).alias("tp"), n(is_gold).alias("n_true"), n(is_pred).alias("n_pred"))
    recall = F.try_divide("tp", "n_true")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return out.withColumn("recall", recall).withColumn("f1", f1)


def macro(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, macro_f1, macro_recall, n_defined)."""
    return classes.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), F.count("recall").alias("n_defined"))


def binary_rates(positive_gold: Column, positive_pred: Column) -> list[Column]:
    """tp, fn, fp, tn, recall, false-positive rate, precision; a prediction that is null is not positive."""
    p = F.coalesce(positive_pred, F.lit(False))
    tp, fn, fp, tn = F.count_if(positive_gold & p), F.count_if(positive_gold & ~p), F.count_if(~positive_gold & p), F.count_if(~positive_gold & ~p)
    return [tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(tp, tp + fp).alias("precision")]


def uniformity(counts: DataFrame, cells: str, place: str, k: str) -> DataFrame:
    """(cells, n, chi2, df, z, p): counts of places 1..cells against equal shares; z and p by the normal limit of chi-square."""
    from assayer.operators.paired import erfc

    whole = counts.groupBy(cells).agg(F.sum(k).alias("n"))
    grid = whole.select(cells, "n", F.explode(F.sequence(F.lit(1), F.col(cells).cast("int"))).alias(place))
    seen = grid.join(counts.select(cells, F.col(place).cast("int").alias(place), k), [cells, place], "left")
    expected = F.col("n") / F.col(cells)
    gap = F.coalesce(F.col(k), F.lit(0)) - expected
    out = seen.groupBy(cells).agg(F.sum(F.coalesce(F.col(k), F.lit(0))).alias("n"), F.sum(gap * gap / expected).alias("chi2")).withColumn("df", F.col(cells) - 1)
    z = F.try_divide(F.col("chi2") - F.col("df"), F.sqrt(2.0 * F.col("df")))
    return out.select(cells, "n", F.round("chi2", 6).alias("chi2"), "df", F.round(z, 6).alias("z"), F.round(erfc(F.abs(z) / 1.4142135623730951), 6).alias("p"))
