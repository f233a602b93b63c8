"""Queries on duplicates hidden by formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import ledger
from assayer.sources.tables import table


def _ledger(spark: SparkSession, sf: str) -> ledger.Ledger:
    return ledger.build(table(spark, sf, "records").select("id", "state", "ingested_at"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.duplicates(_ledger(spark, sf))


def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record per state: its representative, earliest id, ids and rows delivered."""
    return _ledger(spark, sf).all_classes().select("keep_id", "first_id", "n_ids", "n_rows", F.hex("key").alias("key"))


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    """How many states have how many ids."""
    return _ledger(spark, sf).all_classes().groupBy("n_ids").agg(F.count(F.lit(1)).alias("n_states"))


QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed, "p2_copies": p2_copies}
SQL: dict[str, str] = {}
