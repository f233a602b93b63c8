"""Queries on packing documents into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import packing
from assayer.sources.tables import table


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be split: those with a second piece."""
    return p7_packed(spark, sf).where(F.col("piece") == 1).select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, against the fewest that could do."""
    each = p7_packed(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    total = F.sum("used")
    return each.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(total / packing.CAPACITY).alias("fewest"),
        total.alias("tokens"),
        F.round(total / (F.count(F.lit(1)) * packing.CAPACITY), 6).alias("fill"),
        F.max("used").alias("fullest"),
        F.max("items").alias("most_items"),
    )


QUERIES = {"p7_found": p7_found, "p7_packed": p7_packed, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
