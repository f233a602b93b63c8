"""Queries on scalar, array and map functions and the remaining small operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import LETTERS, count_of_signs
from assayer.queries.registry import Registry
from assayer.sources import views
from assayer.sources.tables import table

r = Registry()
_R = views.FIRST_RECORDS_SQL


@r.query("q_prj2_rendered", f"""
SELECT id, length(question) AS question_chars, length(state) AS state_chars, sha256(concat_ws(chr(10), state, question)) AS prompt_hash FROM ({_R}) WHERE state IS NOT NULL AND question IS NOT NULL""")
def rendered(spark: SparkSession, sf: str) -> DataFrame:
    """A record's prompt: lengths and digest (token counts are in p7)."""
    rows = views.first_records(spark, sf).where(F.col("state").isNotNull() & F.col("question").isNotNull())
    return rows.select("id", F.length("question").cast("bigint").alias("question_chars"), F.length("state").cast("bigint").alias("state_chars"), F.sha2(F.concat_ws("\n", "state", "question"), 256).alias("prompt_hash"))


@r.query("q_prj13_subset", "SELECT DISTINCT suite, difficulty FROM exam_inputs")
def subset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exam_inputs").select("suite", "difficulty").distinct()


@r.query("q_flt8_scored_only", "SELECT count(*) FILTER (WHERE correct IS NOT NULL) AS scored, count(*) FILTER (WHERE correct IS NULL) AS unscored, count(*) FILTER (WHERE NOT correct) AS wrong FROM result_log")
def scored_only(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("correct")
    return table(spark, sf, "result_log").agg(F.count_if(c.isNotNull()).alias("scored"), F.count_if(c.isNull()).alias("unscored"), F.count_if(~c).alias("wrong"))


@r.query("q_flt10_subsets", "SELECT source LIKE 'synthetic:%' AS synthetic, count(*) AS n FROM (SELECT CASE WHEN provenance['generator'] IS NOT NULL THEN 'synthetic:' || provenance['generator'] ELSE 'public' END AS source FROM records) GROUP BY 1")
def subsets(spark: SparkSession, sf: str) -> DataFrame:
    g = F.try_element_at("provenance", F.lit("generator"))
    source = F.when(g.isNotNull(), F.concat(F.lit("synthetic:"), g)).otherwise("public")
    return table(spark, sf, "records").groupBy(F.startswith(source, F.lit("synthetic:")).alias("synthetic")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_agg40_position_multisets", f"""
SELECT source, count(*) AS families, count(*) FILTER (WHERE balanced) AS balanced FROM (
  SELECT source, group_id, max(k) - min(k) <= 1 AS balanced FROM (SELECT source, group_id, answer, count(*) AS k FROM ({_R}) WHERE answer IS NOT NULL AND group_id IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY source""")
def position_multisets(spark: SparkSession, sf: str) -> DataFrame:
    """Families whose answers are spread evenly over the letters they use."""
    k = views.first_records(spark, sf).where(F.col("answer").isNotNull() & F.col("group_id").isNotNull()).groupBy("source", "group_id", "answer").agg(F.count(F.lit(1)).alias("k"))
    fam = k.groupBy("source", "group_id").agg((F.max("k") - F.min("k") <= 1).alias("balanced"))
    return fam.groupBy("source").agg(F.count(F.lit(1)).alias("families"), F.count_if("balanced").alias("balanced"))


@r.query("q_agg58_run_summary", f"""
SELECT arm, count(*) AS n, round(count(pred_constrained) / CAST(count(*) AS DOUBLE), 6) AS coverage, max(prompt_tokens) AS longest FROM ({views.RESULTS_SQL}) GROUP BY arm""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.results(spark, sf).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("pred_constrained") / F.count(F.lit(1)), 6).alias("coverage"), F.max("prompt_tokens").alias("longest"))


@r.query("q_srt1_sorted_groups", f"SELECT source, group_id, row_number() OVER (ORDER BY source, group_id) AS place FROM (SELECT DISTINCT source, group_id FROM ({views.RECORDS_SQL}) WHERE group_id IS NOT NULL)")
def sorted_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All groups in order, with their place; sorted by ranges, not in one task."""
    from assayer.plans.prefix import numbered

    groups = views.records(spark, sf).where(F.col("group_id").isNotNull()).select("source", "group_id").distinct()
    return numbered(groups, [], [F.col("source").asc(), F.col("group_id").asc()], "place").drop("n")


@r.query("q_lim1_first_failures", "SELECT log_pos, id, error FROM result_log WHERE error IS NOT NULL ORDER BY log_pos LIMIT 20")
def first_failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").where(F.col("error").isNotNull()).select("log_pos", "id", "error").orderBy("log_pos").limit(20)


@r.query("q_lim4_nearest", "SELECT source, arg_min(confidence, (abs(confidence - CAST(0.9 AS DOUBLE)), log_pos)) AS nearest FROM (SELECT lower(trim(source)) AS source, confidence, log_pos FROM result_log WHERE confidence IS NOT NULL) GROUP BY source")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The value nearest to a given one; ties go to the earlier row."""
    rows = table(spark, sf, "result_log").where(F.col("confidence").isNotNull()).withColumn("source", F.lower(F.trim("source")))
    return rows.groupBy("source").agg(F.min_by("confidence", F.struct(F.abs(F.col("confidence") - F.lit(0.9)), F.col("log_pos"))).alias("nearest"))


@r.query("q_smp5_shuffled", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', 's9', CAST(doc_id AS VARCHAR))), doc_id) AS place FROM documents")
def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded order of all rows, numbered across partitions."""
    from assayer.operators.sampling import rank_key
    from assayer.plans.prefix import numbered

    return numbered(table(spark, sf, "documents").select("doc_id"), [], [rank_key("s9", "doc_id").asc(), F.col("doc_id").asc()], "place").select("doc_id", "place")


@r.query("q_smp6_draws", """
SELECT CAST(b AS INT) AS b, CAST(concat('0x', substr(sha256(concat_ws(':', 's8', CAST(b AS VARCHAR), CAST(j AS VARCHAR))), 1, 12)) AS BIGINT) % 40 AS drawn, count(*) AS weight
FROM range(10) x(b) CROSS JOIN range(40) y(j) GROUP BY ALL""")
def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Resampling with replacement from a counter hash."""
    from assayer.functions.text import number_of

    cells = spark.range(10).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j"))
    drawn = cells.select("b", F.pmod(number_of("s8", F.col("b").cast("string"), F.col("j").cast("string")), F.lit(40)).cast("bigint").alias("drawn"))
    return drawn.groupBy("b", "drawn").agg(F.count(F.lit(1)).alias("weight"))


@r.query("q_set6_equal_sets", "SELECT (SELECT count(*) FROM (SELECT DISTINCT id FROM result_log EXCEPT SELECT id FROM records)) = 0 AS log_inside, (SELECT count(*) FROM (SELECT DISTINCT id FROM records EXCEPT SELECT id FROM result_log)) = 0 AS log_complete")
def equal_sets(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.setops import difference

    d = difference(table(spark, sf, "result_log"), table(spark, sf, "records"), "id")
    return d.agg((F.count_if(F.col("side") == "left") == 0).alias("log_inside"), (F.count_if(F.col("side") == "right") == 0).alias("log_complete"))


@r.query("q_str5_pieces", """
SELECT id, string_split(id, ':')[1] AS head, string_split(id, ':')[-1] AS tail, starts_with(id, 'rfp') AS is_refund, upper(substr(source, 1, 3)) AS code, length(trim(source)) AS n FROM (SELECT DISTINCT id, source FROM records)""")
def pieces(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("id", ":")
    rows = table(spark, sf, "records").select("id", "source").distinct()
    return rows.select("id", parts[0].alias("head"), F.element_at(parts, -1).alias("tail"), F.startswith("id", F.lit("rfp")).alias("is_refund"), F.upper(F.substring("source", 1, 3)).alias("code"), F.length(F.trim("source")).cast("bigint").alias("n"))


@r.query("q_str6_validators", "SELECT count(*) FILTER (WHERE regexp_full_match(exam_sha256, '[0-9a-f]{64}')) AS sha, count(*) FILTER (WHERE regexp_full_match(batch_id, 'b[0-9]{5}')) AS batch, count(*) AS n FROM result_log")
def validators(spark: SparkSession, sf: str) -> DataFrame:
    hit = lambda c, p: F.count_if(F.col(c).rlike(f"^(?:{p})$"))
    return table(spark, sf, "result_log").agg(hit("exam_sha256", "[0-9a-f]{64}").alias("sha"), hit("batch_id", "b[0-9]{5}").alias("batch"), F.count(F.lit(1)).alias("n"))


@r.query("q_str7_letter_index", f"SELECT answer, instr('{LETTERS}', answer) - 1 AS place, count(*) AS n FROM ({_R}) WHERE answer IS NOT NULL GROUP BY ALL")
def letter_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("answer").isNotNull())
    return rows.groupBy("answer", (F.instr(F.lit(LETTERS), F.col("answer")) - 1).cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_str8_marks", "SELECT doc_id, length(text) - length(translate(text, '0123456789', '')) AS digits FROM documents WHERE text IS NOT NULL")
def marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", count_of_signs(F.col("text"), "0123456789").cast("bigint").alias("digits"))


@r.query("q_jsn1_round_trip", "SELECT id, suite, gold FROM exam_inputs")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """To JSON text and back; null fields are kept."""
    text = F.to_json(F.struct("id", "suite", "gold", "difficulty"), {"ignoreNullFields": "false"})
    back = F.from_json(text, "id string, suite string, gold string, difficulty string")
    return table(spark, sf, "exam_inputs").select(back.alias("b")).select("b.id", "b.suite", "b.gold")


@r.query("q_jsn3_leaves")
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    """All leaves of JSON states with their paths, by a table function in Arrow batches; nulls are skipped."""
    import json

    def walk(v: object, path: str) -> list:
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in walk(y, f"{path}.{k}")]
        if isinstance(v, list):
            return [x for i, y in enumerate(v) for x in walk(y, f"{path}[{i}]")]
        return [] if v is None else [(path, v if isinstance(v, str) else json.dumps(v))]

    def of(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["state"], strict=True):
                try:
                    v = json.loads(s)
                except ValueError:
                    continue
                if isinstance(v, (dict, list)):
                    out += [(i, p, x) for p, x in walk(v, "$")]
            yield pd.DataFrame(out, columns=["id", "path", "leaf"])

    rows = table(spark, sf, "records").where(F.col("state").isNotNull() & F.col("id").isNotNull()).select("id", "state").distinct()
    found = rows.mapInPandas(of, "id string, path string, leaf string")
    return found.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("leaf")).alias("n_distinct"))


@r.query("q_mth3_numbers", "SELECT k, round(ln(k), 9) AS ln, round(exp(-k / 10.0::DOUBLE), 9) AS e, round(sqrt(k), 9) AS root, CAST(ceil(k / 4.0::DOUBLE) AS BIGINT) AS up, CAST(round_even(k / 2.0::DOUBLE, 0) AS BIGINT) AS half_even, greatest(2, least(k, 5)) AS clipped FROM range(1, 12) r(k)")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = spark.range(1, 12).withColumnRenamed("id", "k")
    return rows.select("k", F.round(F.log(k.cast("double")), 9).alias("ln"), F.round(F.exp(-k / 10.0), 9).alias("e"), F.round(F.sqrt(k), 9).alias("root"), F.ceil(k / 4.0).alias("up"), F.bround(k / 2.0).cast("bigint").alias("half_even"), F.greatest(F.lit(2), F.least(k, F.lit(5))).alias("clipped"))


@r.query("q_mth3_erfc")
def erfc(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided normal tail of a z value; a batch function, as the engine has none."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return spark.range(0, 40).select((F.col("id") / 10.0).alias("z")).select("z", tail("z").alias("p"))


@r.query("q_arr1_slices", f"""
SELECT id, list_aggregate(list_transform(options[2:3], lambda o: o.label), 'string_agg', ',') AS middle, list_aggregate(list_transform(list_reverse(options), lambda o: o.label), 'string_agg', '') AS backwards FROM ({_R}) WHERE len(options) >= 2""")
def slices(spark: SparkSession, sf: str) -> DataFrame:
    label = lambda a: F.transform(a, lambda o: o["label"])
    rows = views.first_records(spark, sf).where(F.size("options") >= 2)
    return rows.select("id", F.array_join(label(F.slice("options", 2, 2)), ",").alias("middle"), F.array_join(label(F.reverse("options")), "").alias("backwards"))


@r.query("q_arr3_membership", f"SELECT source, count(*) FILTER (WHERE list_contains(list_transform(options, lambda o: o.key), answer_key)) AS holds, round(avg(list_position(list_transform(options, lambda o: o.key), answer_key)), 6) AS mean_place FROM ({_R}) WHERE options IS NOT NULL AND answer_key IS NOT NULL AND list_contains(list_transform(options, lambda o: o.key), answer_key) GROUP BY source")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer_key").isNotNull() & F.array_contains(keys, F.col("answer_key")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("holds"), F.round(F.avg(F.array_position(keys, F.col("answer_key"))), 6).alias("mean_place"))


@r.query("q_arr4_zipped", f"SELECT arm, id, round(list_sum(list_transform(list_zip(z[1:5], z[6:10]), lambda p: abs(p[1] - p[2]))), 6) AS distance FROM ({views.SCORES_SQL})")
def zipped(spark: SparkSession, sf: str) -> DataFrame:
    d = F.zip_with(F.slice("z", 1, 5), F.slice("z", 6, 5), lambda a, b: F.abs(a - b))
    return views.scores(spark, sf).select("arm", "id", F.round(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), 6).alias("distance"))


@r.query("q_map1_maps", "SELECT log_pos, len(list_filter(map_values(probs), lambda p: p >= 0.1)) AS likely, coalesce(probs['A'], 0) AS p_a FROM result_log WHERE probs IS NOT NULL")
def maps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "result_log").where(F.col("probs").isNotNull())
    return rows.select("log_pos", F.cardinality(F.map_filter("probs", lambda k, v: v >= 0.1)).cast("bigint").alias("likely"), F.coalesce(F.try_element_at("probs", F.lit("A")), F.lit(0.0)).alias("p_a"))


@r.query("q_map2_sentinel", """
SELECT count(*) FILTER (WHERE map_contains(provenance, 'dataset')) AS has_key, count(*) FILTER (WHERE NOT map_contains(provenance, 'dataset')) AS no_key, count(*) FILTER (WHERE provenance IS NULL) AS no_map FROM records""")
def sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """A missing name is something else than a name without value."""
    has = F.map_contains_key("provenance", "dataset")
    return table(spark, sf, "records").agg(F.count_if(has).alias("has_key"), F.count_if(~has).alias("no_key"), F.count_if(F.col("provenance").isNull()).alias("no_map"))


@r.query("q_cnd1_priority", f"""
SELECT kind_of_error, count(*) AS n FROM (SELECT CASE WHEN arms < 3 THEN 'incomplete' WHEN bad = 3 THEN 'all wrong' WHEN base_bad AND bad = 1 THEN 'base only' WHEN bad > 0 THEN 'mixed' ELSE 'none' END AS kind_of_error FROM (
  SELECT id, count(*) AS arms, count(*) FILTER (WHERE NOT coalesce(pred_constrained = gold, FALSE)) AS bad, bool_or(arm = 'base-c0' AND NOT coalesce(pred_constrained = gold, FALSE)) AS base_bad FROM ({views.RESULTS_SQL}) GROUP BY id)) GROUP BY 1""")
def priority(spark: SparkSession, sf: str) -> DataFrame:
    """One label per item, by the first rule that holds."""
    wrong = ~F.coalesce(F.col("pred_constrained") == F.col("gold"), F.lit(False))
    per = views.results(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("arms"), F.count_if(wrong).alias("bad"), F.bool_or((F.col("arm") == "base-c0") & wrong).alias("base_bad"))
    kind = F.when(F.col("arms") < 3, "incomplete").when(F.col("bad") == 3, "all wrong").when(F.col("base_bad") & (F.col("bad") == 1), "base only").when(F.col("bad") > 0, "mixed").otherwise("none")
    return per.groupBy(kind.alias("kind_of_error")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_cnd2_criteria", f"""
WITH a AS (SELECT max(acc) FILTER (WHERE arm = 'base-c0') AS base, max(acc) FILTER (WHERE arm = 'seed42') AS tuned FROM (SELECT arm, avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)) AS acc FROM ({views.RESULTS_SQL}) GROUP BY arm))
SELECT 'A' AS criterion, tuned > base AS met FROM a UNION ALL SELECT 'B', tuned >= 0.6 FROM a UNION ALL SELECT 'C', tuned - base >= 0.1 FROM a UNION ALL SELECT 'D', CAST(NULL AS BOOLEAN) FROM a""")
def criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Criteria fixed beforehand; one over an arm that is missing stays undecided."""
    right = F.coalesce(F.col("pred_constrained") == F.col("gold"), F.lit(False)).cast("int")
    of = lambda arm: F.avg(F.when(F.col("arm") == arm, right))
    one = views.results(spark, sf).agg(of("base-c0").alias("base"), of("seed42").alias("tuned"), of("seed99").alias("other"))
    rules = {"A": F.col("tuned") > F.col("base"), "B": F.col("tuned") >= 0.6, "C": F.col("tuned") - F.col("base") >= 0.1, "D": F.col("other") >= 0.5}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("met")) for k, v in rules.items()])).alias("c")).select("c.criterion", "c.met")


@r.query("q_dat1_http_dates", """
SELECT log_pos, strftime(written_at AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S GMT') AS http, epoch(strptime(strftime(written_at AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S'), '%a, %d %b %Y %H:%M:%S'))::BIGINT AS seconds FROM result_log WHERE written_at IS NOT NULL""")
def http_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Times as HTTP dates and back."""
    http = table(spark, sf, "result_log").where(F.col("written_at").isNotNull()).select("log_pos", F.date_format("written_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("http"))
    return http.select("log_pos", "http", F.unix_timestamp(F.to_timestamp(F.substring("http", 6, 20), "dd MMM yyyy HH:mm:ss")).alias("seconds"))


@r.query("q_win1_running_accuracy", """
SELECT log_pos, running_n, round(running_right / CAST(running_n AS DOUBLE), 6) AS running_accuracy FROM (SELECT log_pos, count(*) OVER w AS running_n, sum(CAST(correct AS INT)) OVER w AS running_right FROM result_log WHERE correct IS NOT NULL WINDOW w AS (ORDER BY log_pos))""")
def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of all answers up to each one, over the whole log, without one task seeing all of it."""
    from assayer.plans.prefix import with_prefix_sums

    rows = table(spark, sf, "result_log").where(F.col("correct").isNotNull()).select("log_pos", F.col("correct").cast("int").alias("ok"))
    s = with_prefix_sums(rows, [], [F.col("log_pos").asc()], {"ok": F.col("ok").cast("bigint"), "one": F.lit(1).cast("bigint")})
    n = F.col("one_before") + 1
    return s.select("log_pos", n.alias("running_n"), F.round((F.col("ok_before") + F.col("ok")) / n, 6).alias("running_accuracy"))


@r.query("q_win6_rolling", """
SELECT run, step, round(CASE WHEN count(*) OVER w = 5 THEN avg(loss) OVER w END, 2) AS rolling FROM (SELECT l_suppkey % 5 AS run, l_orderkey // 1000 AS step, sum(l_extendedprice) AS loss FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.series import rolling_mean

    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("run"), F.floor(F.col("l_orderkey") / 1000).cast("bigint").alias("step"), F.col("l_extendedprice").alias("loss"))
    return rolling_mean(rows, "run", "step", "loss", 5).select("run", "step", F.round("rolling", 2).alias("rolling"))


@r.query("q_set8_bag_overlap", f"""
WITH k AS (SELECT split, sha256(list_aggregate(list_sort(from_json(json_extract(state, '$.keywords'), '["VARCHAR"]')), 'string_agg', ',')) AS h FROM ({_R}) WHERE split IS NOT NULL AND json_valid(state) AND json_type(json_extract(TRY_CAST(state AS JSON), '$.keywords')) = 'ARRAY')
SELECT a.split AS side_a, b.split AS side_b, count(*) AS n_common FROM (SELECT DISTINCT * FROM k WHERE h IS NOT NULL) a JOIN (SELECT DISTINCT * FROM k WHERE h IS NOT NULL) b ON a.h = b.h AND a.split <= b.split GROUP BY ALL""")
def bag_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Splits that share a multiset of keywords."""
    from assayer.operators.setops import sides

    k = F.from_json(F.get_json_object("state", "$.keywords"), "array<string>")
    rows = views.first_records(spark, sf).where(F.col("split").isNotNull() & (F.size(k) > 0)).select("split", F.sha2(F.array_join(F.array_sort(k), ","), 256).alias("h"))
    return sides(rows, "h", "split")


@r.query("q_agg9_discordant_by_source", f"""
SELECT a.source, count(*) FILTER (WHERE coalesce(a.pred_constrained = a.gold, FALSE) AND NOT coalesce(b.pred_constrained = b.gold, FALSE)) AS b, count(*) FILTER (WHERE NOT coalesce(a.pred_constrained = a.gold, FALSE) AND coalesce(b.pred_constrained = b.gold, FALSE)) AS c
FROM (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'base-c0') a JOIN (SELECT * FROM ({views.RESULTS_SQL}) WHERE arm = 'seed17') b ON a.id = b.id GROUP BY a.source""")
def discordant_by_source(spark: SparkSession, sf: str) -> DataFrame:
    g = views.results(spark, sf)
    ok = F.coalesce(F.col("pred_constrained") == F.col("gold"), F.lit(False))
    a, b = (g.where(F.col("arm") == x).select("id", "source", ok.alias("ok")) for x in ("base-c0", "seed17"))
    j = a.join(b.select("id", F.col("ok").alias("ok_b")), "id")
    return j.groupBy("source").agg(F.count_if(F.col("ok") & ~F.col("ok_b")).alias("b"), F.count_if(~F.col("ok") & F.col("ok_b")).alias("c"))


@r.query("q_win5_top_sources", "SELECT split, source, n FROM (SELECT split, source, n, row_number() OVER (PARTITION BY split ORDER BY n DESC, source) AS rn FROM (SELECT split, lower(trim(source)) AS source, count(*) AS n FROM records WHERE split IS NOT NULL GROUP BY ALL)) WHERE rn <= 3")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = views.records(spark, sf).where(F.col("split").isNotNull()).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("n"), "source"))).where("rn <= 3").select("split", "source", "n")


QUERIES, SQL = r.queries, r.sql
