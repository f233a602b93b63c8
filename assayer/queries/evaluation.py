"""Queries on accuracy, agreement and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import percent
from assayer.operators import classify, paired
from assayer.operators.options import valid_prediction
from assayer.queries.registry import Registry
from assayer.sources import views
from assayer.sources.tables import table

r = Registry()
_G = views.RESULTS_SQL
_R = views.FIRST_RECORDS_SQL


def _right() -> Column:
    return F.coalesce(F.col("pred_constrained") == F.col("gold"), F.lit(False))


_LOG = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (correct IS NOT NULL) DESC,
  CASE WHEN correct IS NOT NULL THEN -log_pos ELSE log_pos END) AS rn FROM result_log) WHERE rn = 1"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.dedup import compacted

    return compacted(table(spark, sf, "result_log"))


@r.query("q_agg1_count_by_key", "SELECT split, count(*) AS n FROM records GROUP BY split")
def count_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_agg2_count_by_pair", "SELECT suite, gold, count(*) AS n FROM exam_inputs GROUP BY ALL")
def count_by_pair(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exam_inputs").groupBy("suite", "gold").agg(F.count(F.lit(1)).alias("n"))


@r.query("q_agg3_distinct", f"SELECT count(DISTINCT id) AS ids, count(DISTINCT group_id) AS groups, count(DISTINCT state) AS states, count(DISTINCT question) AS questions FROM ({views.RECORDS_SQL})")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = F.count_distinct
    return views.records(spark, sf).agg(d(F.col("id")).alias("ids"), d(F.col("group_id")).alias("groups"), d(F.col("state")).alias("states"), d(F.col("question")).alias("questions"))


@r.query("q_agg4_extremes", "SELECT lang, coalesce(sum(n_chars), 0)::BIGINT AS total, coalesce(max(n_chars), 0) AS longest, coalesce(min(n_chars), 0) AS shortest FROM documents GROUP BY lang")
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and extremes per language; of nothing they are 0, not null."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return table(spark, sf, "documents").groupBy("lang").agg(zero(F.sum("n_chars")).alias("total"), zero(F.max("n_chars")).alias("longest"), zero(F.min("n_chars")).alias("shortest"))


_ACC = "round(avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)), 6)"
_VALID = "round(avg(CAST(coalesce(length(pred_constrained) = 1 AND instr('ABCDEFGHIJKLMNOPQRSTUVWX', pred_constrained) BETWEEN 1 AND n_options, FALSE) AS INT)), 6)"


@r.query("q_agg5_accuracy", f"SELECT arm, source, count(*) AS n, {_ACC} AS accuracy, {_VALID} AS valid_rate FROM ({_G}) GROUP BY ALL")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction that is null or no option of the item counts as wrong and stays in the denominator."""
    valid = valid_prediction(F.col("pred_constrained"), F.col("n_options"))
    return views.results(spark, sf).groupBy("arm", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(_right().cast("int")), 6).alias("accuracy"), F.round(F.avg(valid.cast("int")), 6).alias("valid_rate"))


@r.query("q_agg6_scored_accuracy", f"SELECT lower(trim(source)) AS source, count(correct) AS scored, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({_LOG}) GROUP BY 1")
def scored_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Over scored rows only: a transport failure is neither right nor wrong."""
    log = _log(spark, sf).withColumn("source", F.lower(F.trim("source")))
    return log.groupBy("source").agg(F.count("correct").alias("scored"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


_PAIR = f"""
SELECT a.id, a.source, coalesce(a.pred_constrained = a.gold, FALSE) AS ok_a, coalesce(b.pred_constrained = b.gold, FALSE) AS ok_b
FROM (SELECT * FROM ({_G}) WHERE arm = 'base-c0') a JOIN (SELECT * FROM ({_G}) WHERE arm = 'seed42') b ON a.id = b.id"""
_QUAD = "count(*) FILTER (WHERE ok_a AND ok_b) AS both_right, count(*) FILTER (WHERE NOT ok_a AND NOT ok_b) AS both_wrong, count(*) FILTER (WHERE ok_a AND NOT ok_b) AS only_a, count(*) FILTER (WHERE NOT ok_a AND ok_b) AS only_b"


def _pairs(spark: SparkSession, sf: str, a: str = "base-c0", b: str = "seed42") -> DataFrame:
    g = views.results(spark, sf).select("arm", "id", "source", _right().alias("ok"))
    return paired.aligned(g.where(F.col("arm") == a).drop("arm"), g.where(F.col("arm") == b).drop("arm"))


@r.query("q_agg7_quadrants", f"SELECT {_QUAD} FROM ({_PAIR})")
def quadrants(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).agg(*paired.quadrants(F.col("ok_a"), F.col("ok_b")))


@r.query("q_agg8_gain_by_source", f"SELECT source, count(*) AS n, sum(CAST(ok_a AS INT))::BIGINT AS right_a, sum(CAST(ok_b AS INT))::BIGINT AS right_b, (sum(CAST(ok_b AS INT)) - sum(CAST(ok_a AS INT)))::BIGINT AS gain FROM ({_PAIR}) GROUP BY source")
def gain_by_source(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("int"))
    per = _pairs(spark, sf).groupBy(F.col("source_a").alias("source")).agg(F.count(F.lit(1)).alias("n"), n("ok_a").alias("right_a"), n("ok_b").alias("right_b"))
    return per.withColumn("gain", F.col("right_b") - F.col("right_a")).orderBy(F.desc("gain"), "source")


_CASES = [(115, 671), (1, 142), (0, 13), (997, 962), (0, 0), (5, 5)]


@r.query("q_agg9_mcnemar", f"""
WITH d AS (SELECT * FROM (VALUES {', '.join(map(str, _CASES))}) t(b, c)),
t AS (SELECT b, c, unnest(range(least(b, c) + 1)) AS i FROM d),
l AS (SELECT b, c, lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2) AS x FROM t),
m AS (SELECT b, c, max(x) AS top FROM l GROUP BY b, c),
s AS (SELECT l.b, l.c, top + ln(sum(exp(x - top))) AS tail FROM l JOIN m ON l.b = m.b AND l.c = m.c GROUP BY l.b, l.c, top)
SELECT CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, round(CASE WHEN b + c = 0 THEN 0 ELSE least(0, (ln(2) + tail) / ln(10)) END, 6) AS log10_p,
       round(CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) ** 2 / CAST(b + c AS DOUBLE) END, 6) AS chi2 FROM s""")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    """The exact two-sided p of published discordant pairs, on a logarithmic scale, and the corrected chi squared."""
    d = spark.createDataFrame(_CASES, "b bigint, c bigint")
    return d.select("b", "c", F.round(F.log10(paired.mcnemar_exact(F.col("b"), F.col("c"))), 6).alias("log10_p"), F.round(F.when(F.col("b") + F.col("c") == 0, 0.0).otherwise(paired.mcnemar_chi2(F.col("b"), F.col("c"))), 6).alias("chi2"))


@r.query("q_agg9_mcnemar_arms", f"""
WITH q AS (SELECT {_QUAD} FROM ({_PAIR})), l AS (SELECT only_a, only_b, unnest(range(least(only_a, only_b) + 1)) AS i FROM q),
x AS (SELECT only_a, only_b, lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2) AS x FROM l)
SELECT only_a AS b, only_b AS c, round(least(1, 2 * exp(max(x) + ln(sum(exp(x - (SELECT max(x) FROM x)))))), 9) AS p FROM x GROUP BY only_a, only_b""")
def mcnemar_arms(spark: SparkSession, sf: str) -> DataFrame:
    q = _pairs(spark, sf).agg(*paired.quadrants(F.col("ok_a"), F.col("ok_b")))
    return q.select(F.col("only_a").alias("b"), F.col("only_b").alias("c"), F.round(paired.mcnemar_exact(F.col("only_a"), F.col("only_b")), 9).alias("p"))


_WILSON = "(p + z * z / (2 * n) {} z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)"


@r.query("q_agg10_wilson", f"""
SELECT arm, n, k, round({_WILSON.format('-')}, 6) AS lo, round({_WILSON.format('+')}, 6) AS hi
FROM (SELECT arm, count(*) AS n, count(*) FILTER (WHERE pred_constrained = gold) AS k, CAST(count(*) FILTER (WHERE pred_constrained = gold) AS DOUBLE) / count(*) AS p, CAST(1.95996398454 AS DOUBLE) AS z FROM ({_G}) GROUP BY arm)""")
def wilson(spark: SparkSession, sf: str) -> DataFrame:
    per = views.results(spark, sf).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(_right()).alias("k"))
    k, n = F.col("k"), F.col("n")
    return per.select("arm", "n", "k", F.round(paired.wilson(k, n, False), 6).alias("lo"), F.round(paired.wilson(k, n, True), 6).alias("hi"))


@r.query("q_agg11_binary", f"""
SELECT arm, tp, fn, fp, tn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS precision FROM (
  SELECT arm, count(*) FILTER (WHERE gold = 'A' AND coalesce(pred_constrained = 'A', FALSE)) AS tp, count(*) FILTER (WHERE gold = 'A' AND NOT coalesce(pred_constrained = 'A', FALSE)) AS fn,
         count(*) FILTER (WHERE gold <> 'A' AND coalesce(pred_constrained = 'A', FALSE)) AS fp, count(*) FILTER (WHERE gold <> 'A' AND NOT coalesce(pred_constrained = 'A', FALSE)) AS tn
  FROM ({_G}) WHERE n_options = 2 GROUP BY arm)""")
def binary(spark: SparkSession, sf: str) -> DataFrame:
    """Two-option items, 'A' as the positive class."""
    rows = views.results(spark, sf).where(F.col("n_options") == 2)
    out = rows.groupBy("arm").agg(*classify.binary_rates(F.col("gold") == "A", F.col("pred_constrained") == "A"))
    return out.select("arm", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "precision")])


_FIVE = ("A", "B", "C", "D", "E")
_FIVE_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in _FIVE) + ")"


@r.query("q_agg12_confusion", f"""
SELECT g.l AS gold, p.l AS pred, count(x.id) AS n FROM {_FIVE_SQL} g(l) CROSS JOIN {_FIVE_SQL} p(l)
LEFT JOIN (SELECT * FROM ({_G}) WHERE arm = 'seed42') x ON x.gold = g.l AND x.pred_constrained = p.l GROUP BY ALL""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion(views.results(spark, sf).where(F.col("arm") == "seed42"), _FIVE, "gold", "pred_constrained")


_CLASSES = f"""
SELECT arm, l AS label, count(*) FILTER (WHERE gold = l AND pred_constrained = l) AS tp, count(*) FILTER (WHERE gold = l) AS n_true, count(*) FILTER (WHERE pred_constrained = l) AS n_pred
FROM ({_G}) CROSS JOIN {_FIVE_SQL} f(l) GROUP BY ALL"""


@r.query("q_agg13_macro", f"""
SELECT arm, round(avg(coalesce(2.0 * tp / nullif(n_true + n_pred, 0), 0)), 6) AS macro_f1, round(avg(tp / nullif(n_true, 0)), 6) AS macro_recall, count(tp / nullif(n_true, 0)) AS n_defined
FROM ({_CLASSES}) GROUP BY arm""")
def macro(spark: SparkSession, sf: str) -> DataFrame:
    """A class that never occurs counts as F1 0 and has no recall."""
    m = classify.macro(classify.per_class(views.results(spark, sf), _FIVE, "gold", "pred_constrained", ["arm"]), ["arm"])
    return m.select("arm", F.round("macro_f1", 6).alias("macro_f1"), F.round("macro_recall", 6).alias("macro_recall"), "n_defined")


@r.query("q_agg14_recall", f"SELECT arm, label, tp, n_true, n_pred, round(tp / nullif(n_true, 0), 6) AS recall FROM ({_CLASSES})")
def recall(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.per_class(views.results(spark, sf), _FIVE, "gold", "pred_constrained", ["arm"])
    return c.select("arm", "label", "tp", "n_true", "n_pred", F.round("recall", 6).alias("recall"))


@r.query("q_agg15_weighted", f"""
SELECT arm, round(avg(acc), 6) AS task_equal, round(sum(acc * n) / sum(n), 6) AS sample_weighted FROM (
  SELECT arm, source, count(*) AS n, avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)) AS acc FROM ({_G}) GROUP BY ALL) GROUP BY arm""")
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    per = views.results(spark, sf).groupBy("arm", "source").agg(F.count(F.lit(1)).alias("n"), F.avg(_right().cast("int")).alias("acc"))
    return per.groupBy("arm").agg(F.round(F.avg("acc"), 6).alias("task_equal"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("sample_weighted"))


@r.query("q_agg28_shape", f"""
SELECT source, count(*) AS n, round(avg(s[1]), 4) AS top, round(avg(s[1] - coalesce(s[2], 0)), 4) AS margin, round(avg(list_sum(list_transform(s, lambda p: CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END))), 4) AS entropy
FROM (SELECT lower(trim(source)) AS source, list_reverse_sort(map_values(probs)) AS s FROM ({_LOG}) WHERE cardinality(probs) > 0) GROUP BY source""")
def shape(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.functions import vectors as V

    rows = _log(spark, sf).where(F.cardinality("probs") > 0).select(F.lower(F.trim("source")).alias("source"), F.map_values("probs").alias("p"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_max("p")), 4).alias("top"), F.round(F.avg(V.margin(F.col("p"))), 4).alias("margin"), F.round(F.avg(V.entropy(F.col("p"))), 4).alias("entropy"))


@r.query("q_agg28_histogram", "SELECT floor(confidence * 10) / 10 AS bucket, count(*) AS n FROM result_log WHERE confidence IS NOT NULL GROUP BY 1")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "result_log").where(F.col("confidence").isNotNull())
    return rows.groupBy((F.floor(F.col("confidence") * 10) / 10.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_agg29_no_skill", f"""
WITH x AS (SELECT id, answer, answer_key, len(options) AS n FROM ({_R}) WHERE options IS NOT NULL AND answer IS NOT NULL),
c AS (SELECT n, answer, count(*) AS k FROM x GROUP BY ALL)
SELECT round(avg(1.0 / n), 6) AS uniform, (SELECT round(max(k) / CAST(sum(k) AS DOUBLE), 6) FROM (SELECT answer, count(*) AS k FROM x GROUP BY answer)) AS letter,
       (SELECT round(max(k) / CAST((SELECT count(*) FROM x) AS DOUBLE), 6) FROM (SELECT answer_key, count(*) AS k FROM x WHERE answer_key IS NOT NULL GROUP BY answer_key)) AS key,
       (SELECT round(sum(m) / CAST((SELECT count(*) FROM x) AS DOUBLE), 6) FROM (SELECT n, max(k) AS m FROM c GROUP BY n)) AS by_n_options FROM x""")
def no_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy without looking at the question: chance, best letter, best key, best letter per number of options.

    All four come from counts by (options, letter) and by key, so the rows are read twice and shuffled as counts only.
    """
    x = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer").isNotNull()).select("answer", "answer_key", F.size("options").alias("n"))
    c = x.groupBy("n", "answer").agg(F.count(F.lit(1)).alias("k"))
    named = lambda df, name, value: df.select(F.lit(name).alias("name"), value.cast("double").alias("value"))
    letter = c.groupBy("answer").agg(F.sum("k").alias("k"))
    key = x.where(F.col("answer_key").isNotNull()).groupBy("answer_key").agg(F.count(F.lit(1)).alias("k"))
    by_n = c.groupBy("n").agg(F.max("k").alias("m"))
    parts = [named(c, "total", F.sum("k")), named(c, "chance", F.sum(F.col("k") / F.col("n"))), named(letter, "letter", F.max("k")), named(key, "key", F.max("k")), named(by_n, "by_n", F.sum("m"))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    share = lambda name: F.round(of(name) / of("total"), 6)
    return all_.agg(share("chance").alias("uniform"), share("letter").alias("letter"), share("key").alias("key"), share("by_n").alias("by_n_options"))


_N2 = f"SELECT source, len(options) AS n, answer, group_id FROM ({_R}) WHERE options IS NOT NULL AND answer IS NOT NULL"


@r.query("q_agg32_position_balance", f"""
WITH x AS ({_N2}), e AS (SELECT x.n, unnest(range(1, n + 1)) AS i FROM x)
SELECT 'ABCDEFGHIJKLMNOPQRSTUVWX'[i] AS label, (SELECT count(*) FROM x WHERE answer = 'ABCDEFGHIJKLMNOPQRSTUVWX'[i]) AS observed, round(sum(1.0 / n), 6) AS expected FROM e GROUP BY i""")
def position_balance(spark: SparkSession, sf: str) -> DataFrame:
    """How often each letter is right against what chance gives; counts per (options, letter) come first."""
    x = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer").isNotNull()).groupBy(F.size("options").alias("n"), "answer").agg(F.count(F.lit(1)).alias("k"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWX")
    spread = x.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("label", F.substring(letters, F.col("i"), F.lit(1)))
    expected = spread.groupBy("label").agg(F.round(F.sum(F.col("k") / F.col("n")), 6).alias("expected"))
    observed = x.groupBy(F.col("answer").alias("label")).agg(F.sum("k").alias("observed"))
    return expected.join(observed, "label", "left").select("label", F.coalesce("observed", F.lit(0)).alias("observed"), "expected")


@r.query("q_agg32_position_test", f"""
WITH x AS ({_N2}), c AS (SELECT n, unnest(range(1, n + 1)) AS i, count(*) AS rows_ FROM x GROUP BY n), o AS (SELECT n, instr('ABCDEFGHIJKLMNOPQRSTUVWX', answer) AS i, count(*) AS k FROM x GROUP BY ALL),
e AS (SELECT n, i, (SELECT count(*) FROM x WHERE x.n = d.n) / CAST(n AS DOUBLE) AS expected FROM (SELECT DISTINCT n, i FROM c) d)
SELECT e.n AS n_options, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n, round(sum((coalesce(k, 0) - expected) ** 2 / expected), 6) AS chi2, max(e.n) - 1 AS df,
       round((sum((coalesce(k, 0) - expected) ** 2 / expected) - (max(e.n) - 1)) / sqrt(2.0::DOUBLE * (max(e.n) - 1)), 6) AS z
FROM e LEFT JOIN o ON o.n = e.n AND o.i = e.i GROUP BY e.n""")
def position_test(spark: SparkSession, sf: str) -> DataFrame:
    """Per number of options: chi-square of the answers' places against chance, its degrees of freedom and z."""
    return _position_test(spark, sf).drop("p")


def _position_test(spark: SparkSession, sf: str) -> DataFrame:
    from assayer.operators.classify import uniformity

    x = views.first_records(spark, sf).where(F.col("options").isNotNull() & F.col("answer").isNotNull())
    counts = x.groupBy(F.size("options").cast("bigint").alias("n_options"), F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWX"), F.col("answer")).alias("place")).agg(F.count(F.lit(1)).alias("k"))
    return uniformity(counts, "n_options", "place", "k")


@r.query("q_agg32_position_p")
def position_p(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the two-sided p of z."""
    return _position_test(spark, sf)


@r.query("q_agg31_shortcut", f"""
WITH x AS (SELECT source, group_id, len(options) AS n, CAST(answer = options[list_position(list_transform(options, lambda o: length(o.description)), list_max(list_transform(options, lambda o: length(o.description))))].label AS INT) AS hit
           FROM ({_R}) WHERE len(options) > 0 AND answer IS NOT NULL AND group_id IS NOT NULL),
f AS (SELECT source, group_id, avg(hit - 1.0 / n) AS m FROM x GROUP BY ALL)
SELECT x.source, round(avg(hit), 6) AS accuracy, round(avg(1.0 / n), 6) AS chance, any_value(se) AS se, any_value(families) AS families
FROM x JOIN (SELECT source, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, count(*) AS families FROM f GROUP BY source) s ON s.source = x.source GROUP BY x.source""")
def shortcut(spark: SparkSession, sf: str) -> DataFrame:
    """Whether 'take the longest option' beats chance, with a standard error over families."""
    from assayer.operators.options import longest_option

    rows = views.first_records(spark, sf).where((F.size("options") > 0) & F.col("answer").isNotNull() & F.col("group_id").isNotNull())
    x = rows.select("source", "group_id", F.size("options").alias("n"), (F.col("answer") == longest_option(F.col("options"))).cast("int").alias("hit"))
    f = x.groupBy("source", "group_id").agg(F.count(F.lit(1)).alias("k"), F.sum("hit").alias("hits"), F.sum(1.0 / F.col("n")).alias("chance"))
    m = (F.col("hits") - F.col("chance")) / F.col("k")
    return f.groupBy("source").agg(
        F.round(F.sum("hits") / F.sum("k"), 6).alias("accuracy"),
        F.round(F.sum("chance") / F.sum("k"), 6).alias("chance"),
        F.round(F.stddev_samp(m) / F.sqrt(F.count(F.lit(1))), 6).alias("se"),
        F.count(F.lit(1)).alias("families"),
    )


@r.query("q_agg33_coverage", f"SELECT split, source, len(options) AS n_options, count(*) AS n, count(DISTINCT group_id) AS families FROM ({_R}) GROUP BY ALL")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.first_records(spark, sf)
    return rows.groupBy("split", "source", F.size("options").cast("bigint").alias("n_options")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("group_id")).alias("families"))


@r.query("q_agg34_min_cells", f"""
SELECT t.source, CAST(t.n_options AS BIGINT) AS n_options, count(x.id) AS n, count(x.id) >= t.min_rows AS ok FROM sample_targets t
LEFT JOIN (SELECT * FROM ({_R}) WHERE split = 'test') x ON x.source = t.source AND len(x.options) = t.n_options GROUP BY t.source, t.n_options, t.min_rows""")
def min_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Expected cells against what the test split holds; a cell without rows is there with 0."""
    have = views.first_records(spark, sf).where(F.col("split") == "test").groupBy("source", F.size("options").alias("n_options")).agg(F.count(F.lit(1)).alias("n"))
    want = table(spark, sf, "sample_targets")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return want.join(have, ["source", "n_options"], "left").select("source", F.col("n_options").cast("bigint").alias("n_options"), n.alias("n"), (n >= F.col("min_rows")).alias("ok"))


@r.query("q_agg35_nearest_rank", """
SELECT source, max(CASE WHEN rn = least(n - 1, CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT)) + 1 THEN prompt_tokens END) AS p50,
       max(CASE WHEN rn = least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)) + 1 THEN prompt_tokens END) AS p95, max(prompt_tokens) AS p100
FROM (SELECT lower(trim(source)) AS source, prompt_tokens, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY prompt_tokens) AS rn, count(*) OVER (PARTITION BY lower(trim(source))) AS n
      FROM gen_results WHERE prompt_tokens IS NOT NULL) GROUP BY source""")
def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """sorted[min(n - 1, int(n q))], from counts per value, so no group is sorted row by row."""
    v = table(spark, sf, "gen_results").where(F.col("prompt_tokens").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source"), "prompt_tokens").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source")
    run = v.select("source", "prompt_tokens", F.sum("k").over(w.orderBy("prompt_tokens")).alias("upto"), F.sum("k").over(w).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("prompt_tokens")))
    return run.groupBy("source").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("prompt_tokens").alias("p100"))


@r.query("q_agg36_percentile", "SELECT arm, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.975), 6) AS q975 FROM gen_results GROUP BY arm")
def percentile(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("prompt_tokens", F.lit(q)), 6)
    return table(spark, sf, "gen_results").groupBy("arm").agg(p(0.25).alias("q1"), p(0.975).alias("q975"))


@r.query("q_agg39_mode", f"""
SELECT source, answer, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_id) AS rn FROM (
  SELECT source, answer, count(*) AS n, min(id) AS first_id FROM ({_R}) WHERE answer IS NOT NULL GROUP BY ALL)) WHERE rn = 1""")
def mode(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest answer of each source; ties go to the one seen first (smallest id)."""
    per = views.first_records(spark, sf).where(F.col("answer").isNotNull()).groupBy("source", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    best = per.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), "first_id", "answer")).alias("b"))
    return best.select("source", F.col("b.answer").alias("answer"), (-F.col("b.k")).alias("n"))


@r.query("q_agg41_grouping_sets", f"""
SELECT coalesce(source, 'all') AS source, coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy
FROM (SELECT lower(trim(source)) AS source, coalesce(kind, 'none') AS kind, correct FROM ({_LOG})) GROUP BY GROUPING SETS ((), (source), (kind))""")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Overall, by source and by kind in one pass."""
    log = _log(spark, sf).select(F.lower(F.trim("source")).alias("source"), F.coalesce("kind", F.lit("none")).alias("kind"), "correct")
    out = log.groupingSets([[], [F.col("source")], [F.col("kind")]], F.col("source"), F.col("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("kind", F.lit("all")).alias("kind"), "n", "accuracy")


_ORIGIN = "CASE WHEN provenance['dataset'] IS NOT NULL THEN 'public:' || string_split(provenance['dataset'], '/')[-1] WHEN provenance['generator'] IS NOT NULL THEN 'synthetic:' || provenance['generator'] ELSE 'unknown:' END"


@r.query("q_agg42_rollup", f"""
SELECT coalesce(class, 'all') AS class, coalesce(origin, 'all') AS origin, count(*) AS n FROM (SELECT string_split({_ORIGIN}, ':')[1] AS class, {_ORIGIN} AS origin FROM records) GROUP BY ROLLUP (class, origin)""")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    dataset, generator = F.try_element_at("provenance", F.lit("dataset")), F.try_element_at("provenance", F.lit("generator"))
    kind = F.when(dataset.isNotNull(), F.concat(F.lit("public:"), F.element_at(F.split(dataset, "/"), -1))).when(generator.isNotNull(), F.concat(F.lit("synthetic:"), generator)).otherwise("unknown:")
    rows = table(spark, sf, "records").select(kind.alias("origin")).withColumn("class", F.split_part("origin", F.lit(":"), F.lit(1)))
    out = rows.rollup("class", "origin").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("class", F.lit("all")).alias("class"), F.coalesce("origin", F.lit("all")).alias("origin"), "n")


@r.query("q_agg43_errors", "SELECT coalesce(error, 'none') AS error, count(*) AS n, sum(attempts)::BIGINT AS attempts, min(id) AS first_id FROM result_log GROUP BY 1")
def errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "result_log").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"), F.min("id").alias("first_id"))


@r.query("q_agg44_confidence_by_outcome", f"SELECT lower(trim(source)) AS source, round(avg(confidence) FILTER (WHERE correct), 6) AS when_right, round(avg(confidence) FILTER (WHERE NOT correct), 6) AS when_wrong FROM ({_LOG}) GROUP BY 1")
def confidence_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(c, F.col("confidence"))), 6)
    return _log(spark, sf).groupBy(F.lower(F.trim("source")).alias("source")).agg(mean(F.col("correct")).alias("when_right"), mean(~F.col("correct")).alias("when_wrong"))


_WIDE = f"""SELECT id, max(source) AS source, bool_or(arm = 'base-c0' AND coalesce(pred_constrained = gold, FALSE)) AS base, bool_or(arm = 'seed42' AND coalesce(pred_constrained = gold, FALSE)) AS s42,
  bool_or(arm = 'seed17' AND coalesce(pred_constrained = gold, FALSE)) AS s17, count(*) AS arms FROM ({_G}) GROUP BY id"""


@r.query("q_agg38_family_errors", f"""
SELECT source, count(*) AS families, count(*) FILTER (WHERE base_err) AS base_err, count(*) FILTER (WHERE base_err AND s42_err AND s17_err) AS shared, count(*) FILTER (WHERE s42_err <> s17_err) AS divergent FROM (
  SELECT x.source, x.group_id, bool_or(NOT base) AS base_err, bool_or(NOT s42) AS s42_err, bool_or(NOT s17) AS s17_err FROM ({_WIDE}) w JOIN ({_R}) x ON x.id = w.id WHERE arms = 3 GROUP BY ALL) GROUP BY source""")
def family_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Families in which an arm errs at all, in which all arms do, and in which two seeds differ."""
    g = views.results(spark, sf)
    ok = lambda arm: F.bool_or((F.col("arm") == arm) & _right())
    wide = g.groupBy("id").agg(ok("base-c0").alias("base"), ok("seed42").alias("s42"), ok("seed17").alias("s17"), F.count(F.lit(1)).alias("arms")).where("arms = 3")
    x = views.first_records(spark, sf).select("id", "source", "group_id")
    fam = wide.join(x, "id").groupBy("source", "group_id").agg(*[F.bool_or(~F.col(c)).alias(f"{c}_err") for c in ("base", "s42", "s17")])
    b, p, q = F.col("base_err"), F.col("s42_err"), F.col("s17_err")
    return fam.groupBy("source").agg(F.count(F.lit(1)).alias("families"), F.count_if(b).alias("base_err"), F.count_if(b & p & q).alias("shared"), F.count_if(p != q).alias("divergent"))


@r.query("q_agg37_seed_spread", f"""
SELECT source, round(avg(acc), 6) AS mean_acc, round(stddev_samp(acc), 6) AS sd, bool_and(acc > 0) AS all_positive, bool_or(acc = 0) AS any_zero FROM (
  SELECT source, arm, avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)) AS acc FROM ({_G}) WHERE arm LIKE 'seed%' GROUP BY ALL) GROUP BY source""")
def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    per = views.results(spark, sf).where(F.col("arm").startswith("seed")).groupBy("source", "arm").agg(F.avg(_right().cast("int")).alias("acc"))
    return per.groupBy("source").agg(F.round(F.avg("acc"), 6).alias("mean_acc"), F.round(F.stddev_samp("acc"), 6).alias("sd"), F.every(F.col("acc") > 0).alias("all_positive"), F.bool_or(F.col("acc") == 0).alias("any_zero"))


@r.query("q_agg49_constant_policy", f"""
WITH x AS (SELECT arm, source, pred_constrained AS p, count(*) AS k FROM ({_G}) GROUP BY ALL)
SELECT arm, source, sum(k)::BIGINT AS n, max(k) AS most, max(k) >= sum(k) AS always, max(k) >= ceil(sum(k) * 5 / 6.0) AS five_sixths, max(k) >= ceil(sum(k) * 7 / 8.0) AS seven_eighths FROM x GROUP BY arm, source""")
def constant_policy(spark: SparkSession, sf: str) -> DataFrame:
    """An arm that gives one answer to all, to five sixths or to seven eighths of the items of a source."""
    x = views.results(spark, sf).groupBy("arm", "source", "pred_constrained").agg(F.count(F.lit(1)).alias("k"))
    n, most = F.sum("k"), F.max("k")
    return x.groupBy("arm", "source").agg(n.alias("n"), most.alias("most"), (most >= n).alias("always"), (most >= F.ceil(n * 5 / 6.0)).alias("five_sixths"), (most >= F.ceil(n * 7 / 8.0)).alias("seven_eighths"))


@r.query("q_win8_leave_one_out_mode", f"""
WITH c AS (SELECT x.source, x.group_id, w.pred_constrained AS p, count(*) AS k FROM (SELECT * FROM ({_G}) WHERE arm = 'seed42') w JOIN ({_R}) x ON x.id = w.id WHERE w.pred_constrained IS NOT NULL AND x.group_id IS NOT NULL GROUP BY ALL),
f AS (SELECT DISTINCT source, group_id FROM c), t AS (SELECT source, p, sum(k) AS k FROM c GROUP BY ALL),
l AS (SELECT f.source, f.group_id, t.p, t.k - coalesce(c.k, 0) AS k FROM f JOIN t ON t.source = f.source LEFT JOIN c ON c.source = f.source AND c.group_id = f.group_id AND c.p = t.p)
SELECT source, group_id, p AS mode_of_others, k::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, group_id ORDER BY k DESC, p) AS rn FROM l) WHERE rn = 1""")
def leave_one_out_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest prediction of a source's other families: totals minus a family's own counts."""
    w = views.results(spark, sf).where((F.col("arm") == "seed42") & F.col("pred_constrained").isNotNull()).select("id", F.col("pred_constrained").alias("p"))
    x = views.first_records(spark, sf).where(F.col("group_id").isNotNull()).select("id", "source", "group_id")
    c = w.join(x, "id").groupBy("source", "group_id", "p").agg(F.count(F.lit(1)).alias("own"))
    total = c.groupBy("source", "p").agg(F.sum("own").alias("k"))  # at most letters per source
    fam = c.groupBy("source", "group_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "own"))).alias("own"))  # at most 24 letters
    left = fam.join(F.broadcast(total), "source").select("source", "group_id", "p", (F.col("k") - F.coalesce(F.try_element_at("own", F.col("p")), F.lit(0))).alias("k"))
    best = left.groupBy("source", "group_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "p")).alias("b"))
    return best.select("source", "group_id", F.col("b.p").alias("mode_of_others"), (-F.col("b.k")).alias("k"))


@r.query("q_agg55_constraint_touched", f"""
SELECT arm, count(*) FILTER (WHERE pred_constrained IS DISTINCT FROM pred_unconstrained) AS touched, {_ACC} AS constrained, round(avg(CAST(coalesce(pred_unconstrained = gold, FALSE) AS INT)), 6) AS unconstrained FROM ({_G}) GROUP BY arm""")
def constraint_touched(spark: SparkSession, sf: str) -> DataFrame:
    free = F.coalesce(F.col("pred_unconstrained") == F.col("gold"), F.lit(False))
    return views.results(spark, sf).groupBy("arm").agg(
        F.count_if(~F.equal_null("pred_constrained", "pred_unconstrained")).alias("touched"),
        F.round(F.avg(_right().cast("int")), 6).alias("constrained"),
        F.round(F.avg(free.cast("int")), 6).alias("unconstrained"),
    )


@r.query("q_agg56_regressions", f"SELECT source, count(*) AS n FROM ({_PAIR}) WHERE ok_a AND NOT ok_b GROUP BY source")
def regressions(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where(F.col("ok_a") & ~F.col("ok_b")).groupBy(F.col("source_a").alias("source")).agg(F.count(F.lit(1)).alias("n"))


_VOCAB = ("policy", "refund", "invoice", "template")


@r.query("q_agg57_vocabulary", "SELECT lower(trim(source)) AS source, round(avg(CAST(" + " OR ".join(f"contains(lower(state), '{w}')" for w in _VOCAB) + " AS INT)), 6) AS hit_rate FROM records WHERE state IS NOT NULL GROUP BY 1")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("state")
    hit = F.exists(F.array(*map(F.lit, _VOCAB)), lambda w: F.contains(low, w))
    return views.records(spark, sf).where(F.col("state").isNotNull()).groupBy("source").agg(F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"))


@r.query("q_agg51_duplicate_prompts", "SELECT arm, count(*) AS n, count(DISTINCT prompt_sha256) AS prompts, count(prompt_sha256) - count(DISTINCT prompt_sha256) AS repeated FROM gen_results GROUP BY arm")
def duplicate_prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("prompt_sha256")
    return table(spark, sf, "gen_results").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(p).alias("prompts"), (F.count(p) - F.count_distinct(p)).alias("repeated"))


@r.query("q_agg53_recall_decline", f"""
WITH c AS (SELECT arm, label, tp / nullif(n_true, 0) AS recall FROM ({_CLASSES}))
SELECT a.arm, a.label, round(a.recall - b.recall, 6) AS change FROM c a JOIN c b ON b.label = a.label AND b.arm = 'seed42' WHERE a.recall < b.recall""")
def recall_decline(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.per_class(views.results(spark, sf), _FIVE, "gold", "pred_constrained", ["arm"]).select("arm", "label", "recall")
    base = c.where(F.col("arm") == "seed42").select("label", F.col("recall").alias("was"))
    return c.join(base, "label").where(F.col("recall") < F.col("was")).select("arm", "label", F.round(F.col("recall") - F.col("was"), 6).alias("change"))


_OFFICIAL = {"base-c0": 0.51, "seed42": 0.80, "seed17": 0.80}


@r.query("q_agg59_official_delta", f"""
SELECT arm, round(acc - official, 6) AS delta, abs(acc - official) * 100 > 5 AS far FROM (SELECT arm, avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT)) AS acc FROM ({_G}) GROUP BY arm)
JOIN (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in _OFFICIAL.items())}) t(arm, official)) USING (arm)""")
def official_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Measured against published accuracy, with a flag beyond five points."""
    acc = views.results(spark, sf).groupBy("arm").agg(F.avg(_right().cast("int")).alias("acc"))
    official = spark.createDataFrame(list(_OFFICIAL.items()), "arm string, official double")
    return acc.join(official, "arm").select("arm", F.round(F.col("acc") - F.col("official"), 6).alias("delta"), (F.abs(F.col("acc") - F.col("official")) * 100 > 5).alias("far"))


@r.query("q_cnd3_effect_label", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE ok_a <> ok_b) AS flips, CASE WHEN 5 * count(*) FILTER (WHERE ok_a <> ok_b) >= count(*) THEN 'high' WHEN 20 * count(*) FILTER (WHERE ok_a <> ok_b) <= count(*) THEN 'low' ELSE 'uncertain' END AS label FROM ({_PAIR}) GROUP BY source")
def effect_label(spark: SparkSession, sf: str) -> DataFrame:
    """Integer comparison, so no rounding decides a label."""
    flips, n = F.count_if(F.col("ok_a") != F.col("ok_b")), F.count(F.lit(1))
    label = F.when(5 * flips >= n, "high").when(20 * flips <= n, "low").otherwise("uncertain")
    return _pairs(spark, sf).groupBy(F.col("source_a").alias("source")).agg(n.alias("n"), flips.alias("flips"), label.alias("label"))


@r.query("q_str9_percent", f"SELECT arm, printf('%.2f', 100 * avg(CAST(coalesce(pred_constrained = gold, FALSE) AS INT))) || '%' AS accuracy FROM ({_G}) GROUP BY arm")
def percent_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.results(spark, sf).groupBy("arm").agg(percent(F.avg(_right().cast("int"))).alias("accuracy"))


@r.query("q_lim2_top_letters", f"SELECT answer, count(*) AS n FROM ({_R}) WHERE answer IS NOT NULL GROUP BY answer ORDER BY n DESC, answer LIMIT 5")
def top_letters(spark: SparkSession, sf: str) -> DataFrame:
    return views.first_records(spark, sf).where(F.col("answer").isNotNull()).groupBy("answer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "answer").limit(5)


@r.query("q_agg50_gain_share_by_source", f"SELECT source, round(avg(CAST(ok_b AS INT) - CAST(ok_a AS INT)), 6) AS mean_gain FROM ({_PAIR}) GROUP BY source")
def gain_share_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy(F.col("source_a").alias("source")).agg(F.round(F.avg(F.col("ok_b").cast("int") - F.col("ok_a").cast("int")), 6).alias("mean_gain"))


QUERIES, SQL = r.queries, r.sql
