"""Queries on messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.exactly_once import best_of_repeated, exactly_once, judged_first
from assayer.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "result_log").select("id", "log_pos", "correct")
    return best_of_repeated(log, "id", judged_first()).select("id", "log_pos")


def p1_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    """The log of the earlier batches and the last one, each message once."""
    log = table(spark, sf, "result_log").drop("probs")
    last = F.col("batch_id") == F.lit(log.agg(F.max("batch_id")).first()[0])
    stored, arrived = log.where(~last | F.col("batch_id").isNull()), log.where(F.coalesce(last, F.lit(False)))
    return exactly_once(stored, "id", judged_first(), arrived)


def p1_copies(spark: SparkSession, sf: str) -> DataFrame:
    """How many messages were delivered how many times, and in how many batches at most."""
    log = table(spark, sf, "result_log")
    per = log.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("batch_id").alias("batches"))
    return per.groupBy("copies").agg(F.count(F.lit(1)).alias("messages"), F.max("batches").alias("most_batches"))


QUERIES = {"p1_found": p1_found, "p1_exactly_once": p1_exactly_once, "p1_copies": p1_copies}

_KEPT = """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY (correct IS NOT NULL) DESC,
         CASE WHEN correct IS NOT NULL THEN -log_pos ELSE log_pos END) AS rn,
       count(*) OVER (PARTITION BY id) AS copies
FROM result_log"""

SQL = {
    "p1_found": f"SELECT id, log_pos FROM ({_KEPT}) WHERE rn = 1 AND copies > 1",
    "p1_exactly_once": f"SELECT * EXCLUDE (rn, copies, probs) FROM ({_KEPT}) WHERE rn = 1",
    "p1_copies": """
SELECT copies, count(*) AS messages, max(batches) AS most_batches
FROM (SELECT id, count(*) AS copies, count(DISTINCT batch_id) AS batches FROM result_log GROUP BY id)
GROUP BY copies""",
}
