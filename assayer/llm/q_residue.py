"""Queries on template residue and error pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.residue import residue
from assayer.sources.tables import table


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "records").select("id", "state", "question", "options"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).select("id")


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The records that stay when residue is excluded, per source: ids and rows."""
    records = table(spark, sf, "records").select("id", F.lower(F.trim("source")).alias("source"))
    kept = records.join(_residue(spark, sf).select("id"), "id", "left_anti")
    return kept.groupBy("source").agg(F.countDistinct("id").alias("ids"), F.count(F.lit(1)).alias("n_rows"))


def p4_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("ids"))


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
