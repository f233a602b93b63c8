"""Queries on gates, sources and streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import LETTERS, object_hashes
from assayer.operators import audits
from assayer.operators.options import keys_unique, labels_in_order
from assayer.plans.lineage import new_path, write_text
from assayer.queries.registry import Registry
from assayer.sources import jsonl, sinks, views
from assayer.sources.tables import table
from assayer.streaming import answer_log

r = Registry()
_ARMS = ("base-c0", "seed42", "seed17")
_ARMS_SQL = "(VALUES " + ", ".join(f"('{a}')" for a in _ARMS) + ")"


@r.query("q_gat1_arms", f"""
WITH want AS (SELECT id, arg_min_null(lower(trim(source)), ingested_at) AS src FROM (SELECT id, source, ingested_at FROM records WHERE split IN ('dev', 'calibration', 'test')) GROUP BY id),
per AS (SELECT arm, id, count(*) AS n, min(source) AS source, min(prompt_sha256) AS prompt FROM (SELECT arm, id, lower(trim(source)) AS source, prompt_sha256 FROM gen_results) GROUP BY ALL),
j AS (SELECT coalesce(w.arm, p.arm) AS arm, w.src, p.* EXCLUDE (arm, id) FROM (SELECT id, src, a.arm FROM want CROSS JOIN {_ARMS_SQL} a(arm)) w FULL JOIN per p ON p.arm = w.arm AND p.id = w.id),
c AS (SELECT 'missing' AS "check", arm AS subject, count(*) FILTER (WHERE n IS NULL) AS n_bad, count(*) AS n_seen FROM j GROUP BY arm
 UNION ALL SELECT 'foreign', arm, count(*) FILTER (WHERE src IS NULL), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'repeated', arm, count(*) FILTER (WHERE n > 1), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'source', arm, count(*) FILTER (WHERE n IS NOT NULL AND src IS NOT NULL AND src IS DISTINCT FROM source), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'no_fingerprint', arm, count(*) FILTER (WHERE n IS NOT NULL AND prompt IS NULL), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'prompts_differ', 'all', count(*) FILTER (WHERE k > 1), count(*) FROM (SELECT id, count(DISTINCT prompt) AS k FROM per GROUP BY id))
SELECT "check", subject, n_bad, n_seen, CASE WHEN n_seen = 0 THEN 'unchecked' WHEN n_bad > 0 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def arms(spark: SparkSession, sf: str) -> DataFrame:
    """Every arm against the items of the evaluation splits."""
    rows = views.records(spark, sf).where(F.col("split").isin("dev", "calibration", "test"))
    expected = rows.groupBy("id").agg(F.min_by("source", "ingested_at").alias("source"))
    g = table(spark, sf, "gen_results").withColumn("source", F.lower(F.trim("source")))
    return audits.arm_checks(g, _ARMS, expected)


_CHECKS_SQL = {
    "no_state": "state IS NULL",
    "option_count": "coalesce(len(options) NOT BETWEEN 2 AND 24, TRUE)",
    "labels": f"coalesce(list_aggregate(list_transform(options, lambda o: o.label), 'string_agg', '') <> '{LETTERS}'[1 : len(options)], TRUE)",
    "keys": "coalesce(len(list_distinct(list_transform(options, lambda o: o.key))) <> len(options), TRUE)",
    "answer": "coalesce(len(list_filter(options, lambda o: o.label = answer)) = 0, TRUE)",
}


@r.query("q_gat3_records", " UNION ALL ".join(f"SELECT '{k}' AS \"check\", source AS subject, count(*) FILTER (WHERE {v}) AS n_bad, count(*) AS n_seen, CASE WHEN count(*) FILTER (WHERE {v}) > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({views.FIRST_RECORDS_SQL}) GROUP BY source" for k, v in _CHECKS_SQL.items()))
def records(spark: SparkSession, sf: str) -> DataFrame:
    """Row-level constraints of records in one pass, per source."""
    o = F.col("options")
    checks = {
        "no_state": F.col("state").isNull(),
        "option_count": ~F.size("options").between(2, 24),
        "labels": ~labels_in_order(o),
        "keys": ~keys_unique(o),
        "answer": ~F.exists(o, lambda x: x["label"] == F.col("answer")),
    }
    return audits.report(audits.many(views.first_records(spark, sf), checks, "source"))


@r.query("q_gat3_log_probs", """
SELECT count(*) AS n, count(*) FILTER (WHERE abs(list_sum(map_values(probs)) - 1) > 1e-4) AS not_one, count(*) FILTER (WHERE probs[jev_label] IS NULL) AS label_missing,
       count(*) FILTER (WHERE abs(list_max(map_values(probs)) - confidence) > 1e-9) AS confidence_differs FROM result_log WHERE cardinality(probs) > 0""")
def log_probs(spark: SparkSession, sf: str) -> DataFrame:
    p = F.map_values("probs")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rows = table(spark, sf, "result_log").where(F.cardinality("probs") > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(total - 1) > 1e-4).alias("not_one"),
        F.count_if(F.try_element_at("probs", F.col("jev_label")).isNull()).alias("label_missing"),
        F.count_if(F.abs(F.array_max(p) - F.col("confidence")) > 1e-9).alias("confidence_differs"),
    )


# What one row of the log must satisfy by itself: in Spark and in SQL, true where it is broken.
_TOP = "list_max(map_values(probs))"
_LOG_CHECKS = {
    "confidence_range": ("confidence < 0 OR confidence > 1", "confidence < 0 OR confidence > 1"),
    "judged_without_label": ("correct AND jev_label IS NULL", "correct AND jev_label IS NULL"),
    "judged_without_key": ("correct AND jev_choice_key IS NULL", "correct AND jev_choice_key IS NULL"),
    "judged_with_error": ("correct IS NOT NULL AND error IS NOT NULL", "correct IS NOT NULL AND error IS NOT NULL"),
    "failure_without_error": ("correct IS NULL AND error IS NULL", "correct IS NULL AND error IS NULL"),
    "failure_with_answer": ("correct IS NULL AND (jev_label IS NOT NULL OR confidence IS NOT NULL)", "correct IS NULL AND (jev_label IS NOT NULL OR confidence IS NOT NULL)"),
    "right_but_other_key": ("correct AND jev_choice_key <> gold", "correct AND jev_choice_key <> gold"),
    "wrong_but_same_key": ("NOT correct AND jev_choice_key = gold", "NOT correct AND jev_choice_key = gold"),
    "label_is_no_letter": ("NOT regexp(jev_label, '^[A-X]$')", "NOT regexp_full_match(jev_label, '[A-X]')"),
    "no_attempt": ("attempts < 1", "attempts < 1"),
    "no_kind": ("kind IS NULL", "kind IS NULL"),
    "no_gold": ("gold IS NULL", "gold IS NULL"),
    "sha_form": ("NOT regexp(exam_sha256, '^[0-9a-f]{64}$')", "NOT regexp_full_match(exam_sha256, '[0-9a-f]{64}')"),
    "probs_range": ("exists(map_values(probs), p -> p < 0 OR p > 1)", "len(list_filter(map_values(probs), lambda p: p < 0 OR p > 1)) > 0"),
    "label_not_likeliest": ("cardinality(probs) > 0 AND try_element_at(probs, jev_label) < array_max(map_values(probs)) - 1e-9", f"cardinality(probs) > 0 AND probs[jev_label] < {_TOP} - 1e-9"),
}


@r.query("q_gat3_log", " UNION ALL ".join(f"SELECT '{k}' AS \"check\", lower(trim(source)) AS subject, count(*) FILTER (WHERE coalesce({v}, FALSE)) AS n_bad, count(*) AS n_seen, CASE WHEN count(*) FILTER (WHERE coalesce({v}, FALSE)) > 0 THEN 'fail' ELSE 'pass' END AS status FROM result_log GROUP BY 2" for k, (_, v) in _LOG_CHECKS.items()))
def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Self-consistency of every row of the log, in one pass, per source."""
    rows = table(spark, sf, "result_log").withColumn("source", F.lower(F.trim("source")))
    return audits.report(audits.many(rows, {k: F.coalesce(F.expr(v), F.lit(False)) for k, (v, _) in _LOG_CHECKS.items()}, "source"))


@r.query("q_gat2_items", f"""
WITH w AS (SELECT id, answer, len(options) AS n FROM ({views.FIRST_RECORDS_SQL}) WHERE split IN ('dev', 'calibration', 'test')),
j AS (SELECT g.arm, g.gold, g.n_options, g.split, w.id AS known, w.answer, w.n FROM ({views.RESULTS_SQL}) g LEFT JOIN w ON w.id = g.id),
c AS (SELECT 'unknown_item' AS "check", arm AS subject, count(*) FILTER (WHERE known IS NULL) AS n_bad, count(*) AS n_seen FROM j GROUP BY arm
 UNION ALL SELECT 'gold', arm, count(*) FILTER (WHERE known IS NOT NULL AND gold IS DISTINCT FROM answer), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'n_options', arm, count(*) FILTER (WHERE known IS NOT NULL AND n_options IS DISTINCT FROM n), count(*) FROM j GROUP BY arm
 UNION ALL SELECT 'no_split', arm, count(*) FILTER (WHERE split IS NULL), count(*) FROM j GROUP BY arm)
SELECT *, CASE WHEN n_seen = 0 THEN 'unchecked' WHEN n_bad > 0 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def items_of_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Every answered item against its record: gold and number of options must be those of the sealed item."""
    want = views.first_records(spark, sf).where(F.col("split").isin("dev", "calibration", "test")).select("id", "answer", F.when(F.col("options").isNotNull(), F.size("options")).alias("n"), F.lit(True).alias("known"))
    j = views.results(spark, sf).select("arm", "id", "gold", "n_options", "split").join(want, "id", "left")
    known = F.col("known").isNotNull()
    return audits.report(audits.many(j, {"unknown_item": ~known, "gold": known & ~F.equal_null("gold", "answer"), "n_options": known & ~F.equal_null(F.col("n_options").cast("int"), F.col("n")), "no_split": F.col("split").isNull()}, "arm"))


_DIGEST = "CAST(sum(CAST(concat('0x', substr(sha256({0}), 1, 12)) AS HUGEINT)) AS VARCHAR)"
_REGISTRY = {"base-c0": "decide-2b", "seed17": "decide-2b-lora", "seed42": "decide-2b-lora"}
_STATUS = "CASE WHEN n_seen = 0 THEN 'unchecked' WHEN n_bad > 0 THEN 'fail' ELSE 'pass' END AS status"


@r.query("q_gat4_runs", f"""
WITH g AS (SELECT arm, model, map {{{", ".join(f"'{k}': '{v}'" for k, v in _REGISTRY.items())}}}[arm] AS want FROM gen_results), per AS (SELECT arm, count(DISTINCT model) AS m FROM g GROUP BY arm),
c AS (SELECT 'unregistered_arm' AS "check", arm AS subject, count(*) FILTER (WHERE want IS NULL) AS n_bad, count(*) AS n_seen FROM g GROUP BY arm
 UNION ALL SELECT 'other_model', arm, count(*) FILTER (WHERE want IS NOT NULL AND model IS DISTINCT FROM want), count(*) FROM g GROUP BY arm
 UNION ALL SELECT 'several_models', arm, count(*) FILTER (WHERE m > 1), 1 FROM per GROUP BY arm
 UNION ALL SELECT 'absent_arm', a, count(*) FILTER (WHERE a NOT IN (SELECT arm FROM per)), 1 FROM (VALUES {", ".join(f"('{k}')" for k in _REGISTRY)}) v(a) GROUP BY a)
SELECT *, {_STATUS} FROM c""")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run has one model, and it is the registered one."""
    return audits.run_checks(table(spark, sf, "gen_results"), _REGISTRY)


def _manifest(rows: DataFrame) -> DataFrame:
    return audits.manifest(rows, "split", {"groups": F.col("group_id"), "sources": F.col("source"), "states": F.col("state")}, F.concat_ws("|", "id", "source", "state"))


@r.query("q_gat5_manifest", f"""
SELECT split, count(*) AS n_rows, count(DISTINCT lower(trim(group_id))) AS groups, count(DISTINCT lower(trim(source))) AS sources, count(DISTINCT state) AS states,
       {_DIGEST.format("concat_ws('|', id, lower(trim(source)), state)")} AS digest FROM records GROUP BY split""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild is checked against: counts and a digest per split."""
    return _manifest(views.records(spark, sf))


@r.query("q_gat5_rebuild", f"""
WITH m AS (SELECT coalesce(split, 'none') AS subject, count(*) AS n FROM records GROUP BY 1)
SELECT c AS "check", subject, CAST(CASE WHEN c IN ('n_rows', 'digest') AND subject = 'test' THEN (SELECT count(*) FROM records WHERE split = 'test' AND state IS NULL) > 0 ELSE FALSE END AS BIGINT) AS n_bad, 1 AS n_seen,
       CASE WHEN c IN ('n_rows', 'digest') AND subject = 'test' AND (SELECT count(*) FROM records WHERE split = 'test' AND state IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM m CROSS JOIN (VALUES ('missing'), ('foreign'), ('n_rows'), ('states'), ('digest')) v(c)""")
def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild that loses the test rows without a state, against the manifest: those fields fail, and no others."""
    rows = views.records(spark, sf)
    kept = _manifest(rows).select("split", "n_rows", "states", "digest")
    path = new_path(spark, "manifest")
    kept.write.parquet(path)
    again = rows.where(~((F.col("split") == "test") & F.col("state").isNull()) | F.col("split").isNull()).repartition(5)
    return audits.against_manifest(_manifest(again).select(*kept.columns), spark.read.schema(kept.schema).parquet(path), "split")


_LOCKED = {"alpha": 127, "harbour": 60, "ledger": 60, "orchard": 53}  # fixed values: rows of the sealed exam, by suite


@r.query("q_gat6_locked", f"""
WITH want(suite, n) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _LOCKED.items())}), got AS (SELECT suite, count(*) AS n FROM exam_inputs GROUP BY suite),
j AS (SELECT coalesce(w.suite, g.suite) AS subject, w.n AS a, g.n AS b FROM want w FULL JOIN got g ON g.suite = w.suite), c AS (
SELECT 'missing' AS "check", subject, CAST(b IS NULL AS BIGINT) AS n_bad, 1 AS n_seen FROM j UNION ALL SELECT 'foreign', subject, CAST(a IS NULL AS BIGINT), 1 FROM j
UNION ALL SELECT 'n_rows', subject, CAST(coalesce(a <> b, FALSE) AS BIGINT), 1 FROM j)
SELECT *, {_STATUS} FROM c""")
def locked(spark: SparkSession, sf: str) -> DataFrame:
    """The sealed exam against constants that no build can change."""
    expected = spark.createDataFrame(sorted(_LOCKED.items()), "suite string, n_rows bigint")
    return audits.against_manifest(table(spark, sf, "exam_inputs").groupBy("suite").agg(F.count(F.lit(1)).alias("n_rows")), expected, "suite")


_SPLIT_PAIRS = "(SELECT count(*) FROM (SELECT state FROM records WHERE state IS NOT NULL AND split IS NOT NULL GROUP BY state HAVING count(DISTINCT split) > 1))"
_BUNDLE = f"""
WITH f AS ({views.FIRST_RECORDS_SQL}), g AS (
SELECT 'partition' AS gate, {_SPLIT_PAIRS} AS n_bad, (SELECT count(DISTINCT state) FROM records WHERE state IS NOT NULL AND split IS NOT NULL) AS n_seen
UNION ALL SELECT 'coverage', (SELECT count(*) FROM f WHERE split IS NULL), (SELECT count(*) FROM f)
UNION ALL SELECT 'shortcut', (SELECT count(*) FROM (SELECT source FROM f WHERE options IS NOT NULL AND answer IS NOT NULL AND list_contains(list_transform(options, lambda o: o.label), answer)
    GROUP BY source HAVING avg(CAST(list_filter(options, lambda o: o.label = answer)[1].description = list_sort(list_transform(options, lambda o: o.description))[1] AS INT)) > 0.9)), (SELECT count(DISTINCT source) FROM f WHERE options IS NOT NULL AND answer IS NOT NULL AND list_contains(list_transform(options, lambda o: o.label), answer))
UNION ALL SELECT 'template', (SELECT count(*) FROM f WHERE contains(question, '{{{{') ), (SELECT count(*) FROM f WHERE question IS NOT NULL))
SELECT gate, n_bad, n_seen, {_STATUS} FROM g UNION ALL
SELECT 'all', count(*) FILTER (WHERE n_bad > 0 OR n_seen = 0), count(*), CASE WHEN count(*) FILTER (WHERE n_bad > 0 OR n_seen = 0) > 0 THEN 'fail' ELSE 'pass' END FROM g"""


@r.query("q_gat7_bundle", _BUNDLE)
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The audits of a build and their conjunction; FAILED.json is left beside it where one fails."""
    first = views.first_records(spark, sf)
    states = table(spark, sf, "records").where(F.col("state").isNotNull() & F.col("split").isNotNull()).groupBy("state").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    answered = first.where(F.col("options").isNotNull() & F.exists("options", lambda o: o["label"] == F.col("answer")))
    right = F.filter("options", lambda o: o["label"] == F.col("answer"))[0]["description"]
    told = answered.groupBy("source").agg(F.avg(F.equal_null(right, F.array_min(F.transform("options", lambda o: o["description"]))).cast("int")).alias("share"))
    out = audits.bundle({
        "partition": audits.counted(states, "one_split", F.col("a") != F.col("b")),
        "coverage": audits.counted(first, "split", F.col("split").isNull()),
        "shortcut": audits.counted(told, "first_by_text", F.col("share") > 0.9),
        "template": audits.counted(first.where(F.col("question").isNotNull()), "placeholder", F.contains("question", F.lit("{{"))),
    })
    audits.write_failed(out, new_path(spark, "audit"))
    return out


@r.query("q_gat8_self_check", f"""
WITH a AS (SELECT arm, source, avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)) AS accuracy FROM ({views.RESULTS_SQL}) GROUP BY ALL), b AS (SELECT arm, source, round(accuracy, 6) AS published FROM a)
SELECT 'accuracy' AS "check", concat_ws('/', a.arm, a.source) AS subject, CAST(abs(accuracy - published) > 5e-7 AS BIGINT) AS n_bad, 1 AS n_seen, CASE WHEN abs(accuracy - published) > 5e-7 THEN 'fail' ELSE 'pass' END AS status FROM a JOIN b ON a.arm = b.arm AND a.source = b.source""")
def self_check(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracies recomputed from the rows against a published table of six decimals."""
    right = F.coalesce(F.col("pred_constrained") == F.col("gold"), F.lit(False)).cast("int")
    published = views.results(spark, sf).groupBy("arm", "source").agg(F.round(F.avg(right), 6).alias("accuracy"))
    path = new_path(spark, "published")
    sinks.write_jsonl(published, path)
    kept = spark.read.schema(published.schema).json(path)
    sums = views.results(spark, sf).groupBy("arm", "source").agg((F.sum(right) / F.count(F.lit(1))).alias("accuracy"))
    return audits.self_check(sums, kept, ["arm", "source"], ["accuracy"])


@r.query("q_gat9_key_mapping", """
SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(task.options, lambda o: o.key = gold)) = 1) AS mapped FROM exam_inputs""")
def key_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Every gold key of the exam names exactly one option."""
    hit = F.size(F.filter(F.col("task.options"), lambda o: o["key"] == F.col("gold"))) == 1
    return table(spark, sf, "exam_inputs").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("mapped"))


_GONE = "policy_v3"
_KEPT = "id, source, group_id, split, state, question"


@r.query("q_gat12_retained_equal", f"""
WITH f AS (SELECT {_KEPT} FROM ({views.FIRST_RECORDS_SQL}) WHERE source <> '{_GONE}'),
b AS (SELECT {_KEPT} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS LAST, split NULLS LAST, question NULLS LAST, state NULLS LAST, CAST(options AS VARCHAR) NULLS LAST) AS rn FROM ({views.RECORDS_SQL}) WHERE source <> '{_GONE}') WHERE rn = 1)
SELECT (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM f)) AS only_right, (SELECT count(*) FROM f) AS n_left""")
def retained_equal(spark: SparkSession, sf: str) -> DataFrame:
    """An ablated build (a source removed before rows are chosen) retains the same rows as the full build without that source."""
    columns = _KEPT.split(", ")
    full = views.first_records(spark, sf).where(F.col("source") != _GONE).select(*columns)
    ablated = views.first_of(views.records(spark, sf).where(F.col("source") != _GONE)).select(*columns)
    return audits.same_builds(full, ablated)


@r.query("q_gat15_two_builds", f"SELECT (SELECT count(*) FROM (SELECT {_KEPT} FROM ({views.FIRST_RECORDS_SQL}) EXCEPT ALL SELECT {_KEPT} FROM ({views.FIRST_RECORDS_SQL}))) AS only_left, (SELECT count(*) FROM (SELECT {_KEPT} FROM ({views.FIRST_RECORDS_SQL}) EXCEPT ALL SELECT {_KEPT} FROM ({views.FIRST_RECORDS_SQL}))) AS only_right, (SELECT count(*) FROM ({views.FIRST_RECORDS_SQL})) AS n_left")
def two_builds(spark: SparkSession, sf: str) -> DataFrame:
    """The same build from rows in another layout and order, written and compared."""
    columns = _KEPT.split(", ")
    again = views.first_of(views.records(spark, sf).repartition(7, F.xxhash64("question"))).select(*columns)
    path = new_path(spark, "build")
    again.write.parquet(path)
    return audits.same_builds(views.first_records(spark, sf).select(*columns), spark.read.schema(again.schema).parquet(path))


_SHA = "652e465f7a78dd1b820e6ced3d463ea2f7b37fdad66e462a50367a60d585bc53"


@r.query("q_gat18_backfill", f"""
SELECT exam_sha256, model_requested, count(*) AS n FROM (SELECT coalesce(nullif(exam_sha256, ''), '{_SHA}') AS exam_sha256, coalesce(nullif(model_requested, ''), 'decide-large') AS model_requested, coalesce(nullif(exam_sha256, ''), '{_SHA}') <> '{_SHA}' OR coalesce(nullif(model_requested, ''), 'decide-large') <> 'decide-large' AS bad FROM result_log) WHERE NOT bad GROUP BY ALL""")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Missing identities of the log filled in: all rows validated, written, read back and compared. Rows of another identity are set apart before."""
    values = {"exam_sha256": _SHA, "model_requested": "decide-large"}
    log = table(spark, sf, "result_log").drop("probs")
    other = F.lit(False)
    for c, v in values.items():
        other = other | F.coalesce((F.col(c) != "") & (F.col(c) != v), F.lit(False))
    return audits.backfilled(log.where(~other), values, new_path(spark, "backfill")).groupBy(*values).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_gat20_allowed", f"""SELECT 'arm_allowed' AS "check", arm AS subject, count(*) FILTER (WHERE arm NOT IN ('base-c0', 'seed42')) AS n_bad, count(*) AS n_seen, CASE WHEN arm IN ('base-c0', 'seed42') THEN 'pass' ELSE 'fail' END AS status FROM gen_results GROUP BY arm""")
def allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Arms against a closed list that lacks one of them."""
    return audits.allowed(table(spark, sf, "gen_results"), "arm", ["base-c0", "seed42"])


@r.query("q_stm3_sidecar", f"""
WITH p AS (SELECT batch_id, 'model_requested' AS field, min(model_requested) AS value FROM result_log GROUP BY ALL UNION ALL SELECT batch_id, 'exam_sha256', min(exam_sha256) FROM result_log GROUP BY ALL),
w(field, value) AS (VALUES ('model_requested', 'decide-large'), ('exam_sha256', '{_SHA}'), ('seed', '1'))
SELECT b.batch_id, w.field, CASE WHEN p.field IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM (SELECT DISTINCT batch_id FROM result_log) b CROSS JOIN w LEFT JOIN p ON p.batch_id = b.batch_id AND p.field = w.field WHERE p.field IS NULL OR p.value IS DISTINCT FROM w.value""")
def sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """The identity kept beside a run, key by key and both ways, against that of every batch."""
    return answer_log.sidecar_problems(table(spark, sf, "result_log"), "batch_id", ["model_requested", "exam_sha256"], {"model_requested": "decide-large", "exam_sha256": _SHA, "seed": "1"})


@r.query("q_stm7_incomplete", """
WITH l AS (SELECT batch_id, id, max(CAST(correct IS NOT NULL AS INT)) AS answered FROM result_log GROUP BY ALL)
SELECT batch_id, count(*) AS ids, sum(answered)::BIGINT AS answered, sum(answered) = count(*) AS complete FROM l GROUP BY batch_id""")
def incomplete(spark: SparkSession, sf: str) -> DataFrame:
    """Batches with an identifier that got no answer: to be quarantined and run again."""
    return answer_log.batches(table(spark, sf, "result_log"), "batch_id", "id", F.col("correct").isNotNull())


@r.query("q_gat16_parity", f"""
SELECT count(*) AS n, round(avg(CAST(a.pred_constrained IS NOT DISTINCT FROM b.pred_constrained AS INT)), 6) AS agreement, count(*) FILTER (WHERE a.prompt_sha256 IS DISTINCT FROM b.prompt_sha256 AND a.prompt_sha256 IS NOT NULL AND b.prompt_sha256 IS NOT NULL) AS prompts_differ
FROM (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'seed42') a JOIN (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'seed17') b ON a.id = b.id""")
def parity(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.paired import aligned

    g = views.results(spark, sf).select("arm", "id", "pred_constrained", "prompt_sha256")
    j = aligned(g.where(F.col("arm") == "seed42").drop("arm"), g.where(F.col("arm") == "seed17").drop("arm"))
    same = F.equal_null("pred_constrained_a", "pred_constrained_b")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count_if(F.col("prompt_sha256_a") != F.col("prompt_sha256_b")).alias("prompts_differ"))


@r.query("q_gat11_sealed", "SELECT suite, count(*) AS n, count(DISTINCT id) AS ids, count(*) = count(DISTINCT id) AS sealed FROM exam_inputs GROUP BY suite")
def sealed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exam_inputs").groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("id")).alias("ids"), (F.count(F.lit(1)) == F.count_distinct(F.col("id"))).alias("sealed"))


@r.query("q_stm2_identity", """
SELECT 'model_requested' AS field, count(*) FILTER (WHERE model_requested IS DISTINCT FROM 'decide-large') AS n_bad FROM result_log
UNION ALL SELECT 'exam_sha256', count(*) FILTER (WHERE exam_sha256 IS DISTINCT FROM '652e465f7a78dd1b820e6ced3d463ea2f7b37fdad66e462a50367a60d585bc53') FROM result_log""")
def identity(spark: SparkSession, sf: str) -> DataFrame:
    return answer_log.identity_problems(table(spark, sf, "result_log"), {"model_requested": "decide-large", "exam_sha256": "652e465f7a78dd1b820e6ced3d463ea2f7b37fdad66e462a50367a60d585bc53"})


@r.query("q_stm1_unfinished", "SELECT count(*) AS n FROM (SELECT DISTINCT id FROM records WHERE split = 'test' AND id NOT IN (SELECT id FROM result_log WHERE correct IS NOT NULL))")
def unfinished(spark: SparkSession, sf: str) -> DataFrame:
    inputs = table(spark, sf, "records").where(F.col("split") == "test").select("id").distinct()
    return answer_log.unfinished(inputs, table(spark, sf, "result_log")).agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf: str, name: str, order: str | None = None) -> DataFrame:
    """A table of the test data as a stream of files, by ranges of a column."""
    batch = table(spark, sf, name)
    path = new_path(spark, f"stream-{name}")
    batch.repartitionByRange(3, order or batch.columns[0]).write.parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


@r.query("q_stm4_compacted_stream", """
SELECT id, log_pos, correct FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (correct IS NOT NULL) DESC, CASE WHEN correct IS NOT NULL THEN -log_pos ELSE log_pos END) AS rn FROM result_log) WHERE rn = 1""")
def compacted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream, batch by batch into a bucketed table: equal to compacting it at once."""
    stream = _stream(spark, sf, "result_log")
    target = answer_log.CompactedTable(spark, new_path(spark, "compacted"), stream.schema)
    answer_log.compact_stream(stream, target, new_path(spark, "compacted-checkpoint")).awaitTermination()
    return target.read().select("id", "log_pos", "correct")


@r.query("q_stm_running_accuracy", "SELECT source, count(correct) AS scored, count(*) FILTER (WHERE correct) AS \"right\" FROM result_log GROUP BY source")
def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    name = "running_" + new_path(spark, "x").rpartition("-")[2]
    query = answer_log.running_accuracy(_stream(spark, sf, "result_log")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@r.query("q_stm_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events) GROUP BY ALL")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over all events, in files by time; every window comes out, the last ones too."""
    name = "windows_" + new_path(spark, "x").rpartition("-")[2]
    stream = _stream(spark, sf, "events", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    answer_log.windowed_counts(stream, "ts", "event_type", "1 day", "2 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@r.query("q_src1_jsonl", f"SELECT id, source, len(options) AS n_options, length(state) AS n_chars FROM ({views.FIRST_RECORDS_SQL})")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON lines, read back and verified."""
    rows = views.first_records(spark, sf).select("id", "source", "group_id", "kind", "state", "question", "options", "answer", "answer_key", "split")
    path = new_path(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    back = jsonl.read_jsonl(spark, path, jsonl.RECORD)
    sinks.verify_written(rows, back)
    return back.select("id", "source", F.size("options").cast("bigint").alias("n_options"), F.length("state").cast("bigint").alias("n_chars")).withColumn("n_options", F.when(F.col("n_options") >= 0, F.col("n_options")))


@r.query("q_src10_pairs", f"SELECT DISTINCT source, group_id FROM ({views.RECORDS_SQL}) WHERE group_id IS NOT NULL")
def pairs_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.records(spark, sf).where(F.col("group_id").isNotNull())
    path = new_path(spark, "pairs")
    sinks.write_pairs(rows, "source", "group_id", path)
    return jsonl.read_pairs(spark, path, "source", "group_id")


@r.query("q_src9_set", "SELECT DISTINCT sha256(state) AS value FROM records WHERE state IS NOT NULL")
def set_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records").where(F.col("state").isNotNull()).select(F.sha2("state", 256).alias("h"))
    path = new_path(spark, "set")
    sinks.write_sorted_set(rows, "h", path)
    return jsonl.read_set(spark, path)


_EXAM = "id string, suite string, gold string"


def _exam(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exam_inputs").select("id", "suite", "gold")


@r.query("q_src4_tree", "SELECT suite, count(*) AS n FROM exam_inputs WHERE suite <> 'alpha' GROUP BY suite")
def tree(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines in a tree of folders, some of them left out by name."""
    path = new_path(spark, "tree")
    _exam(spark, sf).withColumn("part", F.col("suite")).write.partitionBy("part").json(path)
    return jsonl.read_tree(spark, path, "*.json", T._parse_datatype_string(_EXAM), "part=alpha").groupBy("suite").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_src5_repaired", "SELECT suite, count(*) AS n FROM exam_inputs GROUP BY suite UNION ALL SELECT 'problem: tail', 1")
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    """A log whose last line was cut off while it was written: all lines before it are read, the tail is reported."""
    path = new_path(spark, "cut") + ".jsonl"
    lines = [r_[0] for r_ in _exam(spark, sf).orderBy("id").select(F.to_json(F.struct("id", "suite", "gold"))).collect()]  # 300 sealed items
    write_text(spark, path, "\n".join([*lines, lines[0][:20]]))
    good, problems = jsonl.read_repaired(spark, path, T._parse_datatype_string(_EXAM))
    told = problems.select(F.concat(F.lit("problem: "), "problem").alias("suite"))
    return good.select("suite").unionByName(told).groupBy("suite").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_src3_array", "SELECT suite, gold, count(*) AS n FROM exam_inputs GROUP BY ALL")
def array(spark: SparkSession, sf: str) -> DataFrame:
    """A file that is one JSON array."""
    path = new_path(spark, "array") + ".json"
    rows = _exam(spark, sf).agg(F.to_json(F.collect_list(F.struct("id", "suite", "gold"))).alias("all")).first()[0]  # 300 sealed items
    write_text(spark, path, rows)
    return jsonl.read_json_array(spark, path, T._parse_datatype_string(_EXAM)).groupBy("suite", "gold").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_src7_bounded", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM exam_inputs")
def bounded(spark: SparkSession, sf: str) -> DataFrame:
    """A sealed file read only if its digest, size and rows are what they should be."""
    path = new_path(spark, "sealed") + ".jsonl"
    body = "\n".join(r_[0] for r_ in _exam(spark, sf).orderBy("id").select(F.to_json(F.struct("id", "suite", "gold"))).collect())  # 300 sealed items
    write_text(spark, path, body)
    rows = jsonl.read_bounded(spark, path, T._parse_datatype_string(_EXAM), sha256=hashlib.sha256(body.encode()).hexdigest())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@r.query("q_src12_pool", "SELECT pool_split, count(*) AS n FROM (SELECT 'train' AS pool_split, id FROM records WHERE split = 'train' UNION ALL SELECT 'test', id FROM records WHERE split = 'test') GROUP BY 1")
def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Splits kept in files of their own, as one table."""
    paths = {}
    for name in ("train", "test"):
        paths[name] = new_path(spark, f"pool-{name}")
        table(spark, sf, "records").where(F.col("split") == name).select("id", "source").write.parquet(paths[name])
    return jsonl.read_pool(spark, paths).groupBy("pool_split").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_snk5_ledger", "SELECT batch_id, count(*) AS n FROM result_log GROUP BY batch_id")
def csv_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger with a header that two writers append to, read back."""
    path = new_path(spark, "ledger")
    log = table(spark, sf, "result_log").select("log_pos", "batch_id")
    for even in (0, 1):
        sinks.append_ledger(log.where(F.col("log_pos") % 2 == even), path)
    return spark.read.option("header", True).schema(log.schema).csv(path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_snk8_verified", "SELECT arm, count(*) AS n FROM gen_results GROUP BY arm")
def verified(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written and compared, as multisets, with what is read back."""
    rows = table(spark, sf, "gen_results")
    path = new_path(spark, "verified")
    rows.write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    sinks.verify_written(rows, back)
    return back.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_str3_object_hash")
def object_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of states that are JSON objects, names sorted, in both spellings of signs beyond ASCII: how many differ."""
    rows = table(spark, sf, "records").where(F.startswith("state", F.lit("{"))).select("source", "state")
    h = rows.select(F.lower(F.trim("source")).alias("source"), object_hashes("state").alias("h")).where(F.col("h").isNotNull())
    return h.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h.plain").alias("states"), F.count_if(F.col("h.plain") != F.col("h.ascii")).alias("differ"))


QUERIES, SQL = r.queries, r.sql
