"""Queries on sampling to target proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import quota_sample
from assayer.sources.tables import table


def _sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return quota_sample.sample(table(spark, sf, "records").select("id", "source", "options"), table(spark, sf, "sample_targets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return quota_sample.unmet(_sample(spark, sf)[1])


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf)[0]


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell of the targets: ids there are, the rounded quota, the least that meets the target, ids drawn, whether it is short."""
    drawn, quotas = _sample(spark, sf)
    counts = drawn.groupBy("source", "n_options").agg(F.count(F.lit(1)).alias("drawn"))
    drawn_ = F.coalesce("drawn", F.lit(0)).cast("bigint").alias("drawn")
    return quotas.join(counts, ["source", "n_options"], "left").select("source", "n_options", "available", "rounded", "needed", drawn_, "short", "change")


QUERIES = {"p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report}
SQL = {
    "p6_found": """
WITH s AS (SELECT count(DISTINCT id) // 5 AS size FROM records),
have AS (SELECT lower(trim(source)) AS source, len(options) AS n, count(DISTINCT id) AS available
         FROM records WHERE options IS NOT NULL GROUP BY 1, 2)
SELECT t.source, CAST(t.n_options AS BIGINT) AS n_options
FROM sample_targets t CROSS JOIN s LEFT JOIN have h ON h.source = t.source AND h.n = t.n_options
WHERE coalesce(h.available, 0) < greatest(t.min_rows, s.size * t.target_ppt // 1000)"""
}
