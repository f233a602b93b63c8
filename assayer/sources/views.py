"""Views that the evaluation queries start from, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.tables import table

ARMS = 6
CLASSES = 10


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as delivered, with source and group in one spelling."""
    r = table(spark, sf, "records")
    return r.withColumn("source", F.lower(F.trim("source"))).withColumn("group_id", F.lower(F.trim("group_id")))


RECORDS_SQL = "SELECT * REPLACE (lower(trim(source)) AS source, lower(trim(group_id)) AS group_id) FROM records"


def first_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per id: the first delivered (ties by split, question and state)."""
    return first_of(records(spark, sf))


def first_of(rows: DataFrame) -> DataFrame:
    from assayer.operators.dedup import first_by

    r = rows.select("id", "source", "group_id", "kind", "state", "question", "options", "answer", "answer_key", "split", "ingested_at")
    return first_by(r, ["id"], [F.col("ingested_at").asc_nulls_last(), F.col("split").asc_nulls_last(), F.col("question").asc_nulls_last(), F.col("state").asc_nulls_last(), F.to_json("options").asc_nulls_last()])


FIRST_RECORDS_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS LAST, split NULLS LAST, question NULLS LAST, state NULLS LAST, CAST(options AS VARCHAR) NULLS LAST) AS rn
  FROM ({RECORDS_SQL})) WHERE rn = 1"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions, one row per arm and id (rows given twice agree in all columns or the first by text wins)."""
    from assayer.operators.dedup import first_by

    g = table(spark, sf, "gen_results").withColumn("source", F.lower(F.trim("source")))
    return first_by(g, ["arm", "id"], [F.col(c).asc_nulls_last() for c in ("pred_constrained", "pred_unconstrained", "gold", "n_options", "prompt_sha256", "source", "split")])


RESULTS_SQL = """
SELECT * EXCLUDE (rn) FROM (
  SELECT * REPLACE (lower(trim(source)) AS source), row_number() OVER (PARTITION BY arm, id ORDER BY pred_constrained NULLS LAST,
    pred_unconstrained NULLS LAST, gold NULLS LAST, n_options NULLS LAST, prompt_sha256 NULLS LAST, lower(trim(source)) NULLS LAST, split NULLS LAST) AS rn
  FROM gen_results) WHERE rn = 1"""


def scores(spark: SparkSession, sf: str, ragged: bool = False) -> DataFrame:
    """Six arms of class scores per item: arm, id, source, group_id, split, z, gold."""
    e = table(spark, sf, "embeddings")
    k = F.element_at(F.array(*map(F.lit, (2, 3, 5, 10))), (1 + F.col("vec_id") % 4).cast("int")) if ragged else F.lit(CLASSES)
    arm = F.explode(F.sequence(F.lit(0), F.lit(ARMS - 1))).alias("arm")
    e = e.select("vec_id", "embedding", "label", arm)
    z = F.transform(F.slice("embedding", 1 + F.col("arm") * CLASSES, k.cast("int")), lambda x: x.cast("double"))
    return e.select(
        "arm",
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 7).alias("source"),
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("group_id"),
        F.when(F.col("vec_id") % 3 == 0, "calibration").otherwise("test").alias("split"),
        z.alias("z"),
        (F.col("label") % k).cast("int").alias("gold"),
    )


def _scores_sql(k: str) -> str:
    return f"""
SELECT arm, vec_id AS id, vec_id % 7 AS source, vec_id // 4 AS group_id,
       CASE WHEN vec_id % 3 = 0 THEN 'calibration' ELSE 'test' END AS split,
       list_transform(embedding[1 + arm * {CLASSES} : arm * {CLASSES} + {k}], lambda x: CAST(x AS DOUBLE)) AS z,
       CAST(label % {k} AS INT) AS gold
FROM embeddings CROSS JOIN (SELECT CAST(unnest(range({ARMS})) AS INT) AS arm)"""


SCORES_SQL = _scores_sql(str(CLASSES))
RAGGED_SQL = _scores_sql("([2, 3, 5, 10])[1 + vec_id % 4]")
