"""Queries on evaluation texts inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.leaks import MATCH, RUN, leaks
from assayer.sources.tables import table


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    exam = table(spark, sf, "exam_inputs").select("id", F.col("task.state").alias("text"))
    return leaks(table(spark, sf, "documents"), exam)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose alignment scores as much as RUN words in a row, and of those the ones that have such a run."""
    leaked = _leaks(spark, sf).where(F.col("score") >= MATCH * RUN)
    return leaked.where(F.col("run") >= RUN).select("doc_id", F.col("item").alias("exam_id"))


def p8_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Each leak by its score, edited copies too: longest common run, words in common runs, score and its share of a full copy's."""
    leaked = _leaks(spark, sf).where(F.col("score") >= MATCH * RUN)
    return leaked.select("doc_id", F.col("item").alias("exam_id"), "run", "shared", "score", F.round(F.col("score") / (F.col("item_words") * MATCH), 4).alias("copied"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked and in how many documents."""
    return p8_found(spark, sf).groupBy("exam_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_alignments": p8_alignments, "p8_items": p8_items}

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
_GRAMS = "unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i : i + {n} - 1], ' ')))"
_FOUND = f"""
SELECT DISTINCT d.doc_id, e.id AS exam_id FROM
(SELECT doc_id, {_GRAMS.format(n=RUN)} AS g FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL)) d
JOIN (SELECT id, {_GRAMS.format(n=RUN)} AS g FROM (SELECT id, {_WORDS.format('task.state')} AS w FROM exam_inputs WHERE task.state IS NOT NULL)) e USING (g)"""
SQL = {"p8_found": _FOUND, "p8_items": f"SELECT exam_id, count(*) AS documents FROM ({_FOUND}) GROUP BY exam_id"}
