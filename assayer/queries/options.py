"""Queries on option lists and answers (projections, predicates, array and map functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import LETTERS
from assayer.operators import options as O
from assayer.queries.registry import Registry
from assayer.sources import views
from assayer.sources.tables import table

r = Registry()
_R = views.FIRST_RECORDS_SQL
_HEX = "list_transform(list_filter(string_split(sha256(id), ''), lambda c: c <> ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))"
_SHIFT = f"CASE WHEN len(options) > 1 THEN 1 + list_reduce(list_prepend(CAST(0 AS BIGINT), {_HEX}), lambda a, c: (a * 16 + c) % greatest(len(options) - 1, 1)) END"


@r.query("q_prj4_gold_label", f"SELECT id, list_filter(options, lambda o: o.key = answer_key)[1].label AS gold_label FROM ({_R}) WHERE options IS NOT NULL AND answer_key IS NOT NULL")
def gold_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer_key").isNotNull())
    return rows.select("id", O.label_of(F.col("options"), F.col("answer_key")).alias("gold_label"))


@r.query("q_prj5_answer_key", f"SELECT id, list_filter(options, lambda o: o.label = answer)[1].key AS found_key FROM ({_R}) WHERE options IS NOT NULL AND answer IS NOT NULL")
def answer_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer").isNotNull())
    return rows.select("id", O.key_of(F.col("options"), F.col("answer")).alias("found_key"))


@r.query("q_prj6_probs_by_key", f"""
SELECT l.log_pos, o.key, l.probs[o.label] AS p
FROM result_log l JOIN (SELECT id, unnest(options) AS o FROM ({_R})) x ON x.id = l.id
WHERE l.probs IS NOT NULL AND l.probs[o.label] IS NOT NULL""")
def probs_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Letter probabilities as semantic-key probabilities, one row per log row and option."""
    log = table(spark, sf, "result_log").where(F.col("probs").isNotNull()).select("log_pos", "id", "probs")
    opts = views.first_records(spark, sf).select("id", "options")
    rows = log.join(opts, "id").select("log_pos", "probs", F.explode("options").alias("o"))
    return rows.select("log_pos", "o.key", F.try_element_at("probs", F.col("o.label")).alias("p")).where(F.col("p").isNotNull())


@r.query("q_prj7_permuted", f"""
SELECT id, s AS shift, list_aggregate(list_transform(turned, lambda o: o.key), 'string_agg', ',') AS key_order,
       '{LETTERS}'[list_position(list_transform(turned, lambda o: o.key), answer_key)] AS new_answer
FROM (SELECT id, s, answer_key, list_concat(options[s + 1 :], options[1 : s]) AS turned
      FROM (SELECT id, options, answer_key, {_SHIFT} AS s FROM ({_R}) WHERE len(options) > 1 AND answer_key IS NOT NULL AND len(list_filter(options, lambda o: o.key = answer_key)) > 0))""")
def permuted(spark: SparkSession, sf: str) -> DataFrame:
    """Options rotated by a shift that follows from the id; the answer is found again by its key."""
    rows = views.first_records(spark, sf).where((F.size("options") > 1) & F.col("answer_key").isNotNull() & F.exists("options", lambda o: o["key"] == F.col("answer_key")))
    rows = rows.withColumn("shift", O.shift_for(F.col("id"), F.size("options")))
    rows = rows.withColumn("turned", O.rotated(F.col("options"), F.col("shift")))
    return rows.select("id", "shift", F.array_join(F.transform("turned", lambda o: o["key"]), ",").alias("key_order"), O.label_of(F.col("turned"), F.col("answer_key")).alias("new_answer"))


@r.query("q_prj8_shift_histogram", f"SELECT len(options) AS n_options, {_SHIFT} AS shift, count(*) AS n FROM ({_R}) WHERE len(options) > 1 GROUP BY ALL")
def shift_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.size("options") > 1)
    return rows.groupBy(F.size("options").cast("bigint").alias("n_options"), O.shift_for(F.col("id"), F.size("options")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_prj1_messages", f"""
SELECT id, 3 AS turns, length(state) + length(question) AS payload_chars FROM ({_R})
WHERE state IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL AND len(options) BETWEEN 2 AND 24""")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """A record as chat turns: system, user (JSON payload), assistant; only records whose options are in order."""
    made = _chats(spark, sf)
    back = _payload("messages")
    return made.select("id", F.size("messages").alias("turns"), (F.length(back["state"]) + F.length(back["question"])).cast("bigint").alias("payload_chars"))


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("state").isNotNull() & F.col("question").isNotNull() & F.col("answer").isNotNull() & F.size("options").between(2, 24))
    payload = F.to_json(F.struct("state", "question", F.col("options")), {"ignoreNullFields": "false"})
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.array(turn("system", F.lit("Answer with one letter.")), turn("user", payload), turn("assistant", F.col("answer")))
    return rows.select("id", chat.alias("messages"))


def _payload(messages: str) -> Column:
    return F.from_json(F.filter(messages, lambda m: m["role"] == "user")[0]["content"], "state string, question string")


@r.query("q_prj3_prompt_turns", f"""
SELECT id, 2 AS turns, 'user' AS last_role, answer AS target, length(state) + length(question) AS payload_chars FROM ({_R})
WHERE state IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL AND len(options) BETWEEN 2 AND 24""")
def prompt_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Chats cut before the assistant's turn, which becomes the target."""
    from assayer.operators.options import prompt_of

    cut = _chats(spark, sf).select("id", prompt_of(F.col("messages")).alias("prompt"), F.element_at("messages", -1)["content"].alias("target"))
    back = _payload("prompt")
    return cut.select("id", F.size("prompt").alias("turns"), F.element_at("prompt", -1)["role"].alias("last_role"), "target", (F.length(back["state"]) + F.length(back["question"])).cast("bigint").alias("payload_chars"))


@r.query("q_prj9_state_kind", f"""
SELECT CASE WHEN state IS NULL THEN 'none' WHEN json_valid(state) AND json_type(TRY_CAST(state AS JSON)) = 'OBJECT' THEN 'object' ELSE 'text' END AS state_kind, count(*) AS n
FROM ({_R}) GROUP BY 1""")
def state_kind(spark: SparkSession, sf: str) -> DataFrame:
    """A state is an object if it parses as one, else text."""
    v = F.try_parse_json("state")
    is_object = v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    kind = F.when(F.col("state").isNull(), "none").when(is_object, "object").otherwise("text")
    return views.first_records(spark, sf).groupBy(kind.alias("state_kind")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_prj10_option_counts", f"SELECT source, len(options) AS n_options, count(*) AS n FROM ({_R}) WHERE options IS NOT NULL GROUP BY ALL")
def option_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull())
    return rows.groupBy("source", F.size("options").cast("bigint").alias("n_options")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_prj11_answer_from_probs", """
SELECT log_pos, list_sort(list_transform(map_entries(probs), lambda e: {'p': -e.value, 'k': e.key}))[1].k AS label
FROM result_log WHERE probs IS NOT NULL AND cardinality(probs) > 0""")
def answer_from_probs(spark: SparkSession, sf: str) -> DataFrame:
    """The label of the greatest probability; ties go to the earlier label."""
    log = table(spark, sf, "result_log").where(F.col("probs").isNotNull() & (F.cardinality("probs") > 0))
    best = F.array_min(F.transform(F.map_entries("probs"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return log.select("log_pos", best["k"].alias("label"))


@r.query("q_prj12_origin", """
SELECT CASE WHEN provenance['dataset'] IS NOT NULL THEN 'public:' || string_split(provenance['dataset'], '/')[-1]
            WHEN provenance['generator'] IS NOT NULL THEN 'synthetic:' || provenance['generator'] ELSE 'unknown' END AS origin, count(*) AS n
FROM records GROUP BY 1""")
def origin(spark: SparkSession, sf: str) -> DataFrame:
    dataset, generator = F.try_element_at("provenance", F.lit("dataset")), F.try_element_at("provenance", F.lit("generator"))
    kind = F.when(dataset.isNotNull(), F.concat(F.lit("public:"), F.element_at(F.split(dataset, "/"), -1))).when(generator.isNotNull(), F.concat(F.lit("synthetic:"), generator)).otherwise("unknown")
    return table(spark, sf, "records").groupBy(kind.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_prj14_renamed", "SELECT id, suite AS source, 'exam' AS paper_split, gold AS gold_key FROM exam_inputs")
def renamed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exam_inputs").select("id", F.col("suite").alias("source"), F.lit("exam").alias("paper_split"), F.col("gold").alias("gold_key"))


@r.query("q_prj15_filled_identity", """
SELECT count(*) FILTER (WHERE coalesce(nullif(exam_sha256, ''), 'none') = 'none') AS filled, count(DISTINCT nullif(exam_sha256, '')) AS known,
       count(*) AS n FROM result_log""")
def filled_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Missing identity fields filled from the one known value; more than one would be a conflict."""
    sha = F.nullif(F.col("exam_sha256"), F.lit(""))
    return table(spark, sf, "result_log").agg(F.count_if(sha.isNull()).alias("filled"), F.count_distinct(sha).alias("known"), F.count(F.lit(1)).alias("n"))


@r.query("q_prj16_mode_by_types", """
SELECT mode, list_aggregate(list_sort(list(DISTINCT ans_type)), 'string_agg', ',') AS types, bool_and(ans_type IN ('choice', 'probabilities')) AS legal
FROM result_log WHERE ans_type IS NOT NULL AND mode IS NOT NULL GROUP BY mode""")
def mode_by_types(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "result_log").where(F.col("ans_type").isNotNull() & F.col("mode").isNotNull())
    return log.groupBy("mode").agg(F.array_join(F.array_sort(F.collect_set("ans_type")), ",").alias("types"), F.every(F.col("ans_type").isin("choice", "probabilities")).alias("legal"))


@r.query("q_prj17_outcome", """
SELECT CASE WHEN correct THEN 'right' WHEN error IS NULL THEN 'wrong' WHEN error LIKE 'invalid_answer%' THEN 'invalid' ELSE 'no answer' END AS outcome,
       correct AS scored, count(*) AS n FROM result_log GROUP BY ALL""")
def outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Three values: right, wrong (also an invalid answer), and no answer, which is not scored."""
    kind = F.when(F.col("correct"), "right").when(F.col("error").isNull(), "wrong").when(F.startswith("error", F.lit("invalid_answer")), "invalid").otherwise("no answer")
    return table(spark, sf, "result_log").groupBy(kind.alias("outcome"), F.col("correct").alias("scored")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_prj18_derived_correct", f"""
SELECT arm, count(*) FILTER (WHERE pred_constrained IS NOT DISTINCT FROM pred_unconstrained) AS agree,
       count(*) FILTER (WHERE pred_constrained = gold) AS right_constrained, count(*) AS n FROM ({views.RESULTS_SQL}) GROUP BY arm""")
def derived_correct(spark: SparkSession, sf: str) -> DataFrame:
    g = views.results(spark, sf)
    return g.groupBy("arm").agg(F.count_if(F.equal_null("pred_constrained", "pred_unconstrained")).alias("agree"), F.count_if(F.col("pred_constrained") == F.col("gold")).alias("right_constrained"), F.count(F.lit(1)).alias("n"))


@r.query("q_prj19_logits", f"""
SELECT arm, id, len(z) AS k, round(list_sum(z), 6) AS total, round(list_max(z), 6) AS top FROM ({views.RAGGED_SQL})""")
def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged logits as arrays in label order; no grouping by label list is needed."""
    s = views.scores(spark, sf, ragged=True)
    return s.select("arm", "id", F.size("z").cast("bigint").alias("k"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("z"), 6).alias("top"))


@r.query("q_flt1_sources", "SELECT count(*) FILTER (WHERE lower(trim(source)) NOT IN ('policy_v3', 'field_forms')) AS kept, count(*) FILTER (WHERE lower(trim(source)) IN ('policy_v3', 'field_forms')) AS dropped FROM records")
def sources(spark: SparkSession, sf: str) -> DataFrame:
    out = F.col("source").isin("policy_v3", "field_forms")
    return views.records(spark, sf).agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("dropped"))


@r.query("q_flt3_valid", f"""
SELECT arm, count(*) FILTER (WHERE coalesce(length(pred_unconstrained) = 1 AND instr('{LETTERS}', pred_unconstrained) BETWEEN 1 AND n_options, FALSE)) AS valid, count(*) AS n
FROM ({views.RESULTS_SQL}) GROUP BY arm""")
def valid(spark: SparkSession, sf: str) -> DataFrame:
    return views.results(spark, sf).groupBy("arm").agg(F.count_if(O.valid_prediction(F.col("pred_unconstrained"), F.col("n_options"))).alias("valid"), F.count(F.lit(1)).alias("n"))


@r.query("q_flt4_strict_letter", f"""
SELECT arm, parsed, count(*) AS n FROM (
  SELECT arm, CASE WHEN length(t) = 1 AND instr('{LETTERS}', t) BETWEEN 1 AND n_options THEN t END AS parsed
  FROM (SELECT arm, n_options, regexp_replace(text_unconstrained, '^\\s+|\\s+$', '', 'g') AS t FROM gen_results)) GROUP BY ALL""")
def strict_letter(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gen_results").select("arm", O.strict_letter(F.col("text_unconstrained"), F.col("n_options")).alias("parsed"))
    return g.groupBy("arm", "parsed").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_flt5_cells", f"SELECT source, len(options) AS n_options, count(*) AS n, count(*) >= 25 AS kept FROM ({_R}) WHERE options IS NOT NULL GROUP BY ALL")
def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells large enough to report, and the bookkeeping of those that are not."""
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull())
    return rows.groupBy("source", F.size("options").cast("bigint").alias("n_options")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 25).alias("kept"))


_SCAFFOLD = ("{main}", "TODO", "<|", "{{", "[[")


@r.query("q_flt6_scaffold", "SELECT id FROM records WHERE " + " OR ".join(f"contains(state, '{m}')" for m in _SCAFFOLD) + " GROUP BY id")
def scaffold(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.exists(F.array(*map(F.lit, _SCAFFOLD)), lambda m: F.contains("state", m))
    return table(spark, sf, "records").where(hit).select("id").distinct()


_GUARDS = {"order_ref": r"[A-Z]{2}-\d{4,6}", "iso_date": r"\d{4}-\d{2}-\d{2}", "week": r"week \d+"}


@r.query("q_flt7_guards", " UNION ALL ".join(f"SELECT '{k}' AS guard, count(*) AS hits FROM records WHERE regexp_matches(state, '{v}')" for k, v in _GUARDS.items()))
def guards(spark: SparkSession, sf: str) -> DataFrame:
    """How many states each pattern of a guard list hits; one pass for all patterns."""
    rows = table(spark, sf, "records").agg(*[F.count_if(F.col("state").rlike(v)).alias(k) for k, v in _GUARDS.items()])
    return rows.select(F.explode(F.create_map(*[x for k in _GUARDS for x in (F.lit(k), F.col(k))])).alias("guard", "hits"))


@r.query("q_flt9_long_leaves", f"SELECT count(*) AS n FROM ({_R}) WHERE length(state) >= 40 AND json_valid(state) AND len(json_keys(TRY_CAST(state AS JSON))) >= 3")
def long_leaves(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.json_object_keys("state")
    return views.first_records(spark, sf).where((F.length("state") >= 40) & (F.size(keys) >= 3)).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_arr2_labels_in_order", f"""
SELECT source, count(*) FILTER (WHERE list_aggregate(list_transform(options, lambda o: o.label), 'string_agg', '') = '{LETTERS}'[1 : len(options)]) AS in_order,
       count(*) FILTER (WHERE len(list_distinct(list_transform(options, lambda o: o.key))) = len(options)) AS keys_unique, count(*) AS n
FROM ({_R}) WHERE options IS NOT NULL GROUP BY source""")
def labels_in_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf).where(F.col("options").isNotNull())
    return rows.groupBy("source").agg(F.count_if(O.labels_in_order(F.col("options"))).alias("in_order"), F.count_if(O.keys_unique(F.col("options"))).alias("keys_unique"), F.count(F.lit(1)).alias("n"))


_MARKS_SQL = f"list_transform(options, lambda o: length(o.description) - length(translate(o.description, '{O.MARKS}', '')))"


@r.query("q_lim3_surface_rules", f"""
SELECT id, options[list_position(list_transform(options, lambda o: length(o.description)), list_max(list_transform(options, lambda o: length(o.description))))].label AS longest,
       options[1].label AS first, options[list_position({_MARKS_SQL}, list_max({_MARKS_SQL}))].label AS marked
FROM ({_R}) WHERE len(options) > 0""")
def surface_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What a rule that looks at the surface only would answer: the longest, the first, the most marked option."""
    rows = views.first_records(spark, sf).where(F.size("options") > 0)
    o = F.col("options")
    return rows.select("id", O.longest_option(o).alias("longest"), F.get(o, F.lit(0))["label"].alias("first"), O.most_marked_option(o).alias("marked"))


@r.query("q_srt3_trailing_number", """
SELECT source, id FROM (SELECT lower(trim(source)) AS source, id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY CAST(string_split(id, ':')[-1] AS BIGINT) DESC, id) AS rn
FROM (SELECT DISTINCT source, id FROM records WHERE regexp_matches(id, ':[0-9]+$'))) WHERE rn <= 3""")
def trailing_number(spark: SparkSession, sf: str) -> DataFrame:
    """The three ids of each source with the greatest trailing number, compared as a number."""
    from pyspark.sql import Window

    ids = table(spark, sf, "records").where(F.col("id").rlike(":[0-9]+$")).select("source", "id").distinct().withColumn("source", F.lower(F.trim("source")))
    number = F.element_at(F.split("id", ":"), -1).cast("bigint")
    return ids.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(number.desc(), "id"))).where("rn <= 3").select("source", "id")


QUERIES, SQL = r.queries, r.sql
