"""Queries on joins, sets, de-duplication, samples, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import content_hash, normalized
from assayer.operators import dedup, sampling, series, setops
from assayer.queries.registry import Registry
from assayer.sources import views
from assayer.sources.tables import table

r = Registry()
_R = views.FIRST_RECORDS_SQL
_RS = views.RECORDS_SQL
_NORM = "array_to_string(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '([\\p{{L}}\\p{{N}}_]+)', 1), ' ')"
_HASH = "sha256(" + _NORM.format("state") + ")"


@r.query("q_str1_normalized", f"SELECT doc_id, sha256({_NORM.format('text')}) AS norm_hash, length({_NORM.format('text')}) AS n FROM documents WHERE text IS NOT NULL")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = normalized("text")
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2(n, 256).alias("norm_hash"), F.length(n).cast("bigint").alias("n"))


@r.query("q_str2_statehash", f"SELECT id, {_HASH} AS statehash FROM ({_R}) WHERE state IS NOT NULL")
def statehash(spark: SparkSession, sf: str) -> DataFrame:
    return views.first_records(spark, sf).where(F.col("state").isNotNull()).select("id", content_hash("state").alias("statehash"))


@r.query("q_str1_exact_agrees")
def exact_agrees(spark: SparkSession, sf: str) -> DataFrame:
    """Parity of the JVM-side normal form with the exact one in Python: texts compared and texts that differ."""
    from assayer.functions.text import normalized_exact

    d = table(spark, sf, "documents").where(F.col("text").isNotNull()).select(normalized("text").alias("a"), normalized_exact("text").alias("b"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


@r.query("q_set3_split_leaks", f"""
WITH h AS (SELECT DISTINCT split, {_HASH} AS k FROM records WHERE state IS NOT NULL AND split IS NOT NULL)
SELECT a.split AS side_a, b.split AS side_b, count(*) AS n_common FROM h a JOIN h b ON a.k = b.k AND a.split <= b.split GROUP BY ALL""")
def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """States, by normal form, that stand in two splits."""
    return setops.sides(table(spark, sf, "records").where(F.col("state").isNotNull()).select("split", content_hash("state").alias("k")), "k", "split")


@r.query("q_set3_overlap_keys", f"""
WITH a AS (SELECT group_id AS k FROM ({_RS}) WHERE split = 'train'), b AS (SELECT group_id AS k FROM ({_RS}) WHERE split = 'test')
SELECT (SELECT count(DISTINCT k) FROM a) AS n_left, (SELECT count(DISTINCT k) FROM b) AS n_right, (SELECT count(*) FROM a WHERE k IS NULL) AS n_null_left,
       (SELECT count(*) FROM b WHERE k IS NULL) AS n_null_right, (SELECT count(*) FROM (SELECT DISTINCT k FROM a WHERE k IS NOT NULL INTERSECT SELECT k FROM b)) AS n_common""")
def overlap_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.records(spark, sf)
    return setops.overlap(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), "group_id")


@r.query("q_set4_uncovered", "SELECT count(*) AS n FROM (SELECT id FROM result_log EXCEPT SELECT id FROM records)")
def uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").select("id").subtract(table(spark, sf, "records").select("id")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_set5_drift", """
SELECT id, 'left' AS side FROM (SELECT id FROM gen_results WHERE arm = 'base-c0' EXCEPT SELECT id FROM gen_results WHERE arm = 'seed42')
UNION ALL SELECT id, 'right' AS side FROM (SELECT id FROM gen_results WHERE arm = 'seed42' EXCEPT SELECT id FROM gen_results WHERE arm = 'base-c0')""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gen_results")
    return setops.difference(g.where(F.col("arm") == "base-c0"), g.where(F.col("arm") == "seed42"), "id")


@r.query("q_set7_conserved", """
WITH p AS (SELECT DISTINCT id FROM records), c AS (SELECT DISTINCT id, coalesce(split, 'none') AS s FROM records), n AS (SELECT id, count(*) AS k FROM c GROUP BY id)
SELECT (SELECT count(*) FROM p) AS n_parent, count(*) AS n_children, count(*) FILTER (WHERE k > 1) AS n_shared,
       (SELECT count(*) FROM (SELECT id FROM p EXCEPT SELECT id FROM c WHERE s IN ('train', 'dev', 'calibration', 'test', 'none'))) AS n_lost,
       (SELECT count(*) FROM (SELECT id FROM c WHERE s IN ('train', 'dev', 'calibration', 'test', 'none') EXCEPT SELECT id FROM p)) AS n_foreign FROM n""")
def conserved(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records").select("id", F.coalesce("split", F.lit("none")).alias("s"))
    return setops.conserved(rows, [rows.where(F.col("s") == s) for s in ("train", "dev", "calibration", "test", "none")], "id")


@r.query("q_set1_union", "SELECT kind, count(*) AS n FROM (SELECT id, 'log' AS kind FROM result_log UNION ALL SELECT id, 'gen' FROM gen_results UNION ALL SELECT id, 'exam' FROM exam_inputs) GROUP BY kind")
def union(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda t, k: table(spark, sf, t).select("id", F.lit(k).alias("kind"))
    return tag("result_log", "log").unionByName(tag("gen_results", "gen")).unionByName(tag("exam_inputs", "exam")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_set2_distinct_union", "SELECT count(*) AS n FROM (SELECT id FROM result_log UNION SELECT id FROM gen_results)")
def distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").select("id").union(table(spark, sf, "gen_results").select("id")).distinct().agg(F.count(F.lit(1)).alias("n"))


_P = "CAST(sum(CAST(concat('0x', substr(sha256(state), {}, 12)) AS HUGEINT)) AS VARCHAR)"


@r.query("q_agg46_digest", "SELECT split, count(*) AS n, concat_ws('-', " + ", ".join(_P.format(1 + 12 * i) for i in range(4)) + ") AS digest FROM (SELECT DISTINCT split, state FROM records WHERE state IS NOT NULL) GROUP BY split")
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return setops.digest(table(spark, sf, "records"), "state", ["split"])


@r.query("q_agg47_keyword_bag", """
SELECT id, sha256(list_aggregate(list_sort(list_distinct(k)), 'string_agg', chr(31))) AS set_hash, sha256(list_aggregate(list_sort(k), 'string_agg', chr(31))) AS bag_hash
FROM (SELECT id, from_json(json_extract(state, '$.keywords'), '["VARCHAR"]') AS k FROM (SELECT DISTINCT id, state FROM records WHERE json_valid(state) AND json_type(json_extract(TRY_CAST(state AS JSON), '$.keywords')) = 'ARRAY')) WHERE len(k) > 0""")
def keyword_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free hashes of a list inside the state: as a set and as a multiset."""
    k = F.from_json(F.get_json_object("state", "$.keywords"), "array<string>")
    rows = table(spark, sf, "records").select("id", "state").distinct().select("id", k.alias("k")).where(F.size("k") > 0)
    return rows.select("id", F.sha2(F.array_join(F.array_sort(F.array_distinct("k")), "\x1f"), 256).alias("set_hash"), F.sha2(F.array_join(F.array_sort("k"), "\x1f"), 256).alias("bag_hash"))


@r.query("q_agg48_fingerprint", "SELECT arm, count(*) AS n, count(DISTINCT sha256(concat_ws('|', id, coalesce(source, ''), coalesce(gold, ''), coalesce(pred_constrained, ''), CAST(coalesce(n_options, -1) AS VARCHAR)))) AS rows_distinct FROM gen_results GROUP BY arm")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by content, some columns left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    f = F.sha2(F.concat_ws("|", "id", text("source"), text("gold"), text("pred_constrained"), F.coalesce("n_options", F.lit(-1)).cast("string")), 256)
    return table(spark, sf, "gen_results").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(f).alias("rows_distinct"))


@r.query("q_ded1_first_content", f"""
SELECT count(*) AS kept, count(DISTINCT source) AS sources FROM (SELECT source, row_number() OVER (PARTITION BY {_HASH} ORDER BY ingested_at NULLS LAST, id) AS rn FROM ({_R}) WHERE state IS NOT NULL) WHERE rn = 1""")
def first_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("state").isNotNull()).select("id", "source", "state", "ingested_at")
    kept = dedup.first_content(rows, content_hash("state"), [F.col("ingested_at").asc_nulls_last(), F.col("id").asc()])
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct(F.col("source")).alias("sources"))


@r.query("q_ded2_repeated_ids", "SELECT id, count(*) AS copies FROM records GROUP BY id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.repeated(table(spark, sf, "records"), ["id"])


@r.query("q_ded3_compacted", """
SELECT id, log_pos, correct, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (correct IS NOT NULL) DESC, CASE WHEN correct IS NOT NULL THEN -log_pos ELSE log_pos END) AS rn FROM result_log) WHERE rn = 1""")
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.compacted(table(spark, sf, "result_log")).select("id", "log_pos", "correct", "confidence")


_FROZEN = "substr(sha256(id), 1, 1) = '0'"


@r.query("q_jon5_frozen_excluded", f"SELECT count(*) AS n FROM ({_R}) WHERE state IS NOT NULL AND {_HASH} NOT IN (SELECT {_HASH} FROM ({_R}) WHERE state IS NOT NULL AND {_FROZEN})")
def frozen_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose content is on a frozen list are left out (anti join on the hash)."""
    rows = views.first_records(spark, sf).where(F.col("state").isNotNull()).select("id", content_hash("state").alias("h"))
    frozen = rows.where(F.substring(F.sha2("id", 256), 1, 1) == "0").select("h")
    return rows.join(frozen, "h", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_jon6_semi", f"SELECT count(*) AS n FROM ({_R}) WHERE id IN (SELECT id FROM result_log WHERE correct)")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    right = table(spark, sf, "result_log").where("correct").select("id")
    return views.first_records(spark, sf).join(right, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_jon1_inner", "SELECT r.split, count(*) AS n FROM result_log l JOIN (SELECT DISTINCT id, split FROM records) r ON l.id = r.id GROUP BY r.split")
def inner(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").select("id").join(table(spark, sf, "records").select("id", "split").distinct(), "id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_jon2_align", """
SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.id IS NULL) AS only_a, count(*) FILTER (WHERE a.id IS NULL) AS only_b
FROM (SELECT DISTINCT id FROM gen_results WHERE arm = 'base-c0') a FULL JOIN (SELECT DISTINCT id FROM gen_results WHERE arm = 'seed17') b ON a.id = b.id""")
def align(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.paired import alignment

    g = table(spark, sf, "gen_results")
    return alignment(g.where(F.col("arm") == "base-c0"), g.where(F.col("arm") == "seed17"))


@r.query("q_jon3_all_arms", "SELECT n_arms, golds, count(*) AS ids FROM (SELECT id, count(DISTINCT arm) AS n_arms, count(DISTINCT gold) AS golds FROM gen_results GROUP BY id) GROUP BY ALL")
def all_arms(spark: SparkSession, sf: str) -> DataFrame:
    """The N-way join in long form: arms per id and whether they agree on the gold answer."""
    per = table(spark, sf, "gen_results").groupBy("id").agg(F.count_distinct(F.col("arm")).alias("n_arms"), F.count_distinct(F.col("gold")).alias("golds"))
    return per.groupBy("n_arms", "golds").agg(F.count(F.lit(1)).alias("ids"))


@r.query("q_jon4_lookup", "SELECT t.source, t.n_options, count(r.id) AS n FROM sample_targets t LEFT JOIN (SELECT DISTINCT id, lower(trim(source)) AS source, len(options) AS n FROM records WHERE options IS NOT NULL) r ON r.source = t.source AND r.n = t.n_options GROUP BY ALL")
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    have = views.records(spark, sf).where(F.col("options").isNotNull()).select("id", "source", F.size("options").alias("n_options")).distinct()
    return table(spark, sf, "sample_targets").select("source", "n_options").join(have, ["source", "n_options"], "left").groupBy("source", "n_options").agg(F.count("id").alias("n"))


@r.query("q_jon7_pairwise_agreement", f"""
SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, count(*) FILTER (WHERE a.pred_constrained IS NOT DISTINCT FROM b.pred_constrained) AS agree
FROM ({views.RESULTS_SQL}) a JOIN ({views.RESULTS_SQL}) b ON a.id = b.id AND a.arm < b.arm GROUP BY ALL""")
def pairwise_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of arms once; the arms of an id meet by its key, so no nested loop is needed."""
    g = views.results(spark, sf).select("id", "arm", "pred_constrained")
    a, b = g.select("id", F.col("arm").alias("arm_a"), F.col("pred_constrained").alias("x")), g.select("id", F.col("arm").alias("arm_b"), F.col("pred_constrained").alias("y"))
    j = a.join(b, "id").where(F.col("arm_a") < F.col("arm_b"))
    return j.groupBy("arm_a", "arm_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.equal_null("x", "y")).alias("agree"))


_EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0001)


@r.query("q_jon10_bands", f"""
SELECT b.i AS band, count(*) AS n, round(avg(l.confidence), 4) AS mean_value, round(avg(CAST(l.correct AS INT)), 6) AS accuracy FROM result_log l
JOIN (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False)))}) t(i, lo, hi)) b ON l.confidence >= b.lo AND l.confidence < b.hi
WHERE l.correct IS NOT NULL GROUP BY b.i""")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    """A range join on fixed edges as a count of edges passed: no join at all."""
    from assayer.operators.calibration import banded

    rows = table(spark, sf, "result_log").where(F.col("correct").isNotNull() & F.col("confidence").isNotNull())
    out = banded(rows, [], "confidence", "correct", _EDGES)
    return out.select("band", "n", F.round("mean_value", 4).alias("mean_value"), F.round("accuracy", 6).alias("accuracy"))


@r.query("q_jon11_zip", """
SELECT a.rn AS place, a.id AS id_a, b.id AS id_b FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM exam_inputs WHERE suite = 'alpha') a
JOIN (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM exam_inputs WHERE suite = 'ledger') b ON a.rn = b.rn""")
def zipped(spark: SparkSession, sf: str) -> DataFrame:
    """Two ordered lists zipped by place (the exam is of fixed size)."""
    e = table(spark, sf, "exam_inputs")
    at = lambda s, n: e.where(F.col("suite") == s).select(F.col("id").alias(n), F.row_number().over(Window.orderBy("id")).alias("place"))
    return at("alpha", "id_a").join(at("ledger", "id_b"), "place").select(F.col("place").cast("bigint").alias("place"), "id_a", "id_b")


@r.query("q_jon13_field_equality", f"""
SELECT count(*) AS pairs, count(*) FILTER (WHERE a.gold IS DISTINCT FROM b.gold AND a.gold IS NOT NULL AND b.gold IS NOT NULL) AS gold_differs,
       count(*) FILTER (WHERE a.n_options IS DISTINCT FROM b.n_options AND a.n_options IS NOT NULL AND b.n_options IS NOT NULL) AS n_options_differs
FROM (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'base-c0') a JOIN (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'seed42') b ON a.id = b.id""")
def field_equality(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.paired import aligned

    g = views.results(spark, sf).select("arm", "id", "gold", "n_options")
    j = aligned(g.where(F.col("arm") == "base-c0").drop("arm"), g.where(F.col("arm") == "seed42").drop("arm"))
    differs = lambda c: F.count_if(F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))).alias(f"{c}_differs")
    return j.agg(F.count(F.lit(1)).alias("pairs"), differs("gold"), differs("n_options"))


@r.query("q_jon14_exact_copies", f"SELECT count(*) AS pairs, count(DISTINCT e.id) AS items FROM exam_inputs e JOIN ({_R}) x ON sha256({_NORM.format('e.task.state')}) = sha256({_NORM.format('x.state')})")
def exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "exam_inputs").select(F.col("id").alias("exam_id"), content_hash(F.col("task.state")).alias("h"))
    x = views.first_records(spark, sf).select(content_hash("state").alias("h"))
    return x.join(e, "h").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.col("exam_id")).alias("items"))


@r.query("q_win2_first_wins", f"SELECT split, count(*) AS n FROM (SELECT split, row_number() OVER (PARTITION BY {_HASH} ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 WHEN 'calibration' THEN 2 WHEN 'test' THEN 3 ELSE 4 END, id) AS rn FROM ({_R}) WHERE state IS NOT NULL) WHERE rn = 1 GROUP BY split")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).when(F.col("split") == "calibration", 2).when(F.col("split") == "test", 3).otherwise(4)
    rows = views.first_records(spark, sf).where(F.col("state").isNotNull()).select("id", "split", "state")
    return dedup.first_content(rows, content_hash("state"), [order.asc(), F.col("id").asc()]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_SEED_G = "sha256(concat_ws(':', 's1', source, group_id))"


@r.query("q_smp2_holdout_groups", f"""
SELECT source, group_id FROM (SELECT source, group_id, row_number() OVER (PARTITION BY source ORDER BY {_SEED_G}, group_id) AS rn, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT DISTINCT source, group_id FROM ({_RS}) WHERE group_id IS NOT NULL)) WHERE rn <= greatest(1, round_even(n * CAST(0.05 AS DOUBLE), 0))""")
def holdout_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.holdout_groups(views.records(spark, sf), "source", "group_id", 0.05, "s1")


@r.query("q_smp1_sample", "SELECT doc_id FROM documents ORDER BY sha256(concat_ws(':', 's1', CAST(doc_id AS VARCHAR))), doc_id LIMIT 200")
def sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(table(spark, sf, "documents").select("doc_id"), 200, "s1", "doc_id")


@r.query("q_smp3_balanced", f"""
SELECT source, n_options, id, answer FROM (SELECT *, row_number() OVER (PARTITION BY source, n_options ORDER BY turn, answer) AS place FROM (
  SELECT source, len(options) AS n_options, id, answer, row_number() OVER (PARTITION BY source, len(options), answer ORDER BY sha256(concat_ws(':', 's2', id)), id) AS turn FROM ({_R}) WHERE answer IS NOT NULL AND options IS NOT NULL)) WHERE place <= 12""")
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source and number of options twelve records, answers in turn."""
    rows = views.first_records(spark, sf).where(F.col("answer").isNotNull() & F.col("options").isNotNull()).select("source", F.size("options").cast("bigint").alias("n_options"), "id", "answer")
    return sampling.balanced(rows, "answer", 12, "s2", "id", ["source", "n_options"])


@r.query("q_smp4_quota", f"SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', 's3', id)), id) AS rn FROM ({_R}) WHERE split = 'train') WHERE rn <= 30 GROUP BY source")
def quota(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("split") == "train").select("id", "source")
    return sampling.sample_per(rows, ["source"], 30, "s3", "id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_SEED_Q = "sha256(concat_ws(':', 's4', source, group_id))"


@r.query("q_win9_sequential_quotas", f"""
SELECT source, split, count(*) AS groups FROM (SELECT source, CASE WHEN rn <= 2 THEN 'dev' WHEN rn <= 5 THEN 'calibration' ELSE 'test' END AS split
  FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY {_SEED_Q}, group_id) AS rn FROM (SELECT DISTINCT source, group_id FROM ({_RS}) WHERE group_id IS NOT NULL)) WHERE rn <= 9) GROUP BY ALL""")
def sequential_quotas(spark: SparkSession, sf: str) -> DataFrame:
    dealt = sampling.sequential_quotas(views.records(spark, sf), "source", "group_id", [("dev", 2), ("calibration", 3), ("test", 4)], "s4")
    return dealt.groupBy("source", "split").agg(F.count(F.lit(1)).alias("groups"))


@r.query("q_win3_round_robin", """
SELECT turn, suite, id FROM (SELECT suite, id, row_number() OVER (PARTITION BY suite ORDER BY id) AS turn FROM exam_inputs) WHERE turn <= 5""")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.round_robin(table(spark, sf, "exam_inputs").select("suite", "id"), "suite", [F.col("id").asc()], "s5")
    return rows.where(F.col("turn") <= 5).orderBy("turn", "place").select(F.col("turn").cast("bigint").alias("turn"), "suite", "id")


@r.query("q_win4_representative", f"SELECT source, group_id, min(id) AS id, arg_min_null(split, id) AS split FROM ({_R}) WHERE group_id IS NOT NULL GROUP BY ALL")
def representative(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("group_id").isNotNull())
    return rows.groupBy("source", "group_id").agg(F.min("id").alias("id"), F.min_by("split", "id").alias("split"))


@r.query("q_win5_first_families", f"SELECT source, group_id FROM (SELECT source, group_id, row_number() OVER (PARTITION BY source ORDER BY group_id) AS rn FROM (SELECT DISTINCT source, group_id FROM ({_RS}) WHERE group_id IS NOT NULL)) WHERE rn <= 10")
def first_families(spark: SparkSession, sf: str) -> DataFrame:
    groups = views.records(spark, sf).where(F.col("group_id").isNotNull()).select("source", "group_id").distinct()
    return groups.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("group_id"))).where("rn <= 10").select("source", "group_id")


_STEPS = "SELECT l_suppkey % 5 AS run, l_orderkey // 1000 AS step, l_extendedprice AS loss FROM lineitem"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("run"), F.floor(F.col("l_orderkey") / 1000).cast("bigint").alias("step"), F.col("l_extendedprice").alias("loss"))


@r.query("q_win6_last_mean", f"""
SELECT run, count(*) AS n_steps, round(CASE WHEN count(*) = 10 THEN avg(loss) END, 2) AS last_mean FROM (SELECT run, loss, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn
  FROM (SELECT run, step, sum(loss) AS loss FROM ({_STEPS}) GROUP BY ALL)) WHERE rn <= 10 GROUP BY run""")
def last_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = series.last_mean(_steps(spark, sf), "run", "step", "loss", 10)
    return out.select("run", "n_steps", F.round("last_mean", 2).alias("last_mean"))


@r.query("q_win7_validity", f"""
SELECT run, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE parts <> 2) AS uneven, count(*) FILTER (WHERE NOT isfinite(loss)) AS not_finite FROM (
  SELECT run, parts, loss, step - lag(step) OVER (PARTITION BY run ORDER BY step) <> 1 AS gap FROM (SELECT run, step, sum(loss) AS loss, count(*) AS parts FROM ({_STEPS}) GROUP BY ALL)) GROUP BY run""")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    return series.validity(_steps(spark, sf), "run", "step", "loss", 2)


@r.query("q_jsn2_path", "SELECT json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS has_value, count(*) AS n FROM events WHERE json_valid(props) AND len(json_keys(props)) > 0 GROUP BY 1")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    key = F.get(F.json_object_keys("props"), F.lit(0))
    found = F.try_element_at(F.from_json("props", "map<string,string>"), key)
    return table(spark, sf, "events").where(key.isNotNull()).groupBy(found.isNotNull().alias("has_value")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_jsn2_state_fields", f"SELECT source, json_extract_string(state, '$.facts.tier') AS tier, count(*) AS n FROM ({_R}) WHERE json_valid(state) AND json_extract_string(state, '$.facts.tier') IS NOT NULL GROUP BY ALL")
def state_fields(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.get_json_object("state", "$.facts.tier")
    return views.first_records(spark, sf).where(tier.isNotNull()).groupBy("source", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_jsn4_fingerprint", """SELECT id, sha256('{"gold":' || to_json(gold)::VARCHAR || ',"id":' || to_json(id)::VARCHAR || ',"suite":' || to_json(suite)::VARCHAR || '}') AS fingerprint FROM exam_inputs""")
def json_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of canonical JSON: compact, names in order."""
    return table(spark, sf, "exam_inputs").select("id", F.sha2(F.to_json(F.struct("gold", "id", "suite"), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


@r.query("q_dat1_days", "SELECT CAST(date_trunc('day', written_at AT TIME ZONE 'UTC') AS VARCHAR)[1 : 10] AS day, count(*) AS n, count(correct) AS scored FROM result_log GROUP BY 1")
def days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").groupBy(F.date_format("written_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count("correct").alias("scored"))


QUERIES, SQL = r.queries, r.sql
