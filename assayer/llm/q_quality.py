"""Queries on text statistics and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import quality
from assayer.sources.tables import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.shaped(_documents(spark, sf)).where(F.col("shape") != "prose").select("doc_id", "shape")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(_documents(spark, sf)).drop("text_key", "structure", "possible", "certain")


def p9_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(_documents(spark, sf))


def p9_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Against the raters' shapes: labelled documents, and how many agree with and without the outlier scores."""
    labels = table(spark, sf, "doc_labels").where(F.col("shape").isNotNull()).groupBy("doc_id").agg(F.min_by("shape", "rated_at").alias("label"))
    docs = _documents(spark, sf)
    with_ = quality.shaped(docs).join(labels, "doc_id")
    alone = quality.statistics(docs).select("doc_id", F.when(F.col("certain"), "junk").otherwise(F.col("structure")).alias("alone")).join(labels.select("doc_id"), "doc_id", "left_semi")
    j = with_.join(alone, "doc_id")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("shape") == F.col("label")).alias("agree"), F.count_if(F.col("alone") == F.col("label")).alias("agree_without_scores"))


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_outliers": p9_outliers, "p9_labelled": p9_labelled}
SQL: dict[str, str] = {}
