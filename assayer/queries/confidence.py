"""Queries on class scores: calibration, temperature, selective accuracy, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import vectors as V
from assayer.operators import calibration as C
from assayer.operators import resample as B
from assayer.queries.registry import Registry
from assayer.sources import views
from assayer.sources.tables import table

r = Registry()
_S, _RAG = views.SCORES_SQL, views.RAGGED_SQL


def _items_sql(scores: str = _S) -> str:
    """The same items in SQL: softmax, first argmax, NLL and Brier of each row."""
    return f"""
SELECT arm, id, source, group_id, split, gold, pred, CAST(pred = gold AS INT) AS correct, list_max(p) AS pmax, lse - z[gold + 1] AS nll,
       list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i = gold + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2)) AS brier
FROM (SELECT *, list_transform(z, lambda x: exp(x - lse)) AS p, CAST(list_position(z, list_max(z)) - 1 AS INT) AS pred
      FROM (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS lse FROM ({scores})))"""


_ITEMS = _items_sql()
_BIN = f"len(list_filter(list_transform(range(1, {C.BINS}), lambda i: i / CAST({C.BINS} AS DOUBLE)), lambda e: e <= pmax))"


def _six(df: DataFrame, keys: tuple[str, ...], *values: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(v, digits).alias(v) for v in values])


@r.query("q_mth1_softmax", f"SELECT arm, id, round(list_max(p), 6) AS top, round(list_sum(p), 6) AS total FROM (SELECT arm, id, list_transform(z, lambda x: exp(x - lse)) AS p FROM (SELECT arm, id, z, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS lse FROM ({_RAG})))")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    p = V.softmax(F.col("z"))
    return views.scores(spark, sf, ragged=True).select("arm", "id", F.round(F.array_max(p), 6).alias("top"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@r.query("q_mth2_argmax", f"SELECT arm, id, CAST(list_position(z, list_max(z)) - 1 AS INT) AS pred FROM ({_RAG})")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    return views.scores(spark, sf, ragged=True).select("arm", "id", V.first_argmax(F.col("z")).alias("pred"))


@r.query("q_mth4_grid", "SELECT CAST(i AS INT) AS i, round(0.05::DOUBLE * pow(400.0::DOUBLE, i / 100.0::DOUBLE), 9) AS t FROM range(101) g(i)")
def grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(V.geometric_grid(0.05, 20.0, 101)).alias("i", "t")).select("i", F.round("t", 9).alias("t"))


@r.query("q_mth5_digitize", f"SELECT bin, count(*) AS n FROM (SELECT {_BIN} AS bin FROM ({_ITEMS})) GROUP BY bin")
def digitize(spark: SparkSession, sf: str) -> DataFrame:
    return C.items(views.scores(spark, sf)).groupBy(C.bin_of(F.col("pmax")).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@r.query("q_agg16_nll", f"SELECT arm, round(avg(nll), 6) AS nll FROM ({_ITEMS}) GROUP BY arm")
def nll(spark: SparkSession, sf: str) -> DataFrame:
    return _six(C.items(views.scores(spark, sf)).groupBy("arm").agg(F.avg("nll").alias("nll")), ("arm",), "nll")


@r.query("q_agg17_brier", f"SELECT arm, round(avg(brier), 6) AS brier FROM ({_items_sql(_RAG)}) GROUP BY arm")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return _six(C.items(views.scores(spark, sf, ragged=True)).groupBy("arm").agg(F.avg("brier").alias("brier")), ("arm",), "brier")


_ECE = f"SELECT {{by}}, sum(abs(ok / n - conf / n) * n) / sum(n) AS ece FROM (SELECT {{by}}, {_BIN} AS bin, count(*) AS n, sum(correct) AS ok, sum(pmax) AS conf FROM ({{items}}) GROUP BY ALL) GROUP BY {{by}}"


@r.query("q_agg18_ece", f"SELECT arm, round(ece, 6) AS ece FROM ({_ECE.format(by='arm', items=_ITEMS)})")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return _six(C.ece(C.items(views.scores(spark, sf)), ["arm"]), ("arm",), "ece")


@r.query("q_agg19_items", f"SELECT arm, id, pred, correct, round(pmax, 6) AS pmax, round(nll, 6) AS nll, round(brier, 6) AS brier FROM ({_ITEMS})")
def items(spark: SparkSession, sf: str) -> DataFrame:
    return _six(C.items(views.scores(spark, sf)), ("arm", "id", "pred", "correct"), "pmax", "nll", "brier")


@r.query("q_agg20_summary", f"""
SELECT s.arm, n, round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier, round(mean_pmax, 6) AS mean_pmax, round(ece, 6) AS ece
FROM (SELECT arm, count(*) AS n, avg(correct) AS accuracy, avg(nll) AS nll, avg(brier) AS brier, avg(pmax) AS mean_pmax FROM ({_ITEMS}) GROUP BY arm) s JOIN ({_ECE.format(by='arm', items=_ITEMS)}) e ON e.arm = s.arm""")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return _six(C.summary(C.items(views.scores(spark, sf)), ["arm"]), ("arm", "n"), "accuracy", "nll", "brier", "mean_pmax", "ece")


_POINTS = 4001
_NLL_T = "avg(list_max(z) / t + ln(list_sum(list_transform(z, lambda x: exp(x / t - list_max(z) / t)))) - z[gold + 1] / t)"


@r.query("q_agg21_temperature", f"""
WITH g AS (SELECT 0.05::DOUBLE * pow(400.0::DOUBLE, i / {_POINTS - 1}.0::DOUBLE) AS t FROM range({_POINTS}) r(i) UNION SELECT 1.0),
n AS (SELECT arm, t, {_NLL_T} AS nll FROM ({_S}) CROSS JOIN g WHERE split = 'calibration' GROUP BY ALL)
SELECT arm, round(arg_min(t, nll), 6) AS temperature, round(min(nll), 6) AS nll, arg_min(t, nll) > 19.9 OR arg_min(t, nll) < 0.0501 AS at_boundary FROM n GROUP BY arm""")
def temperature(spark: SparkSession, sf: str) -> DataFrame:
    fit = C.temperature_fit(views.scores(spark, sf).where(F.col("split") == "calibration"), ["arm"], points=_POINTS)
    return fit.select("arm", F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"), "at_boundary")


_COV = ", ".join(f"CAST({c} AS DOUBLE)" for c in C.COVERAGES)


@r.query("q_agg22_selective", f"""
SELECT arm, coverage, k, round(avg(correct), 6) AS accuracy FROM (
  SELECT arm, correct, rn, coverage, CAST(ceil(coverage * n) AS BIGINT) AS k FROM (
    SELECT arm, correct, row_number() OVER (PARTITION BY arm ORDER BY round(pmax, 9) DESC, id) AS rn, count(*) OVER (PARTITION BY arm) AS n FROM ({_ITEMS}))
  CROSS JOIN (SELECT unnest([{_COV}]) AS coverage)) WHERE rn <= k GROUP BY ALL""")
def selective(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.items(views.scores(spark, sf)).withColumn("pmax", F.round("pmax", 9))
    return _six(C.selective(rows, ["arm"]), ("arm", "coverage", "k"), "accuracy")


@r.query("q_agg27_binned", f"""
SELECT arm, source, {_BIN} AS bin, count(*) AS n, round(avg(pmax), 6) AS mean_p, round(avg(correct), 6) AS accuracy FROM ({_ITEMS}) GROUP BY ALL""")
def binned(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.items(views.scores(spark, sf))
    out = rows.groupBy("arm", "source", C.bin_of(F.col("pmax")).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("pmax").alias("mean_p"), F.avg("correct").alias("accuracy"))
    return _six(out, ("arm", "source", "bin", "n"), "mean_p", "accuracy")


@r.query("q_agg30_auc", """
SELECT source, n, round((rp - CAST(p AS DOUBLE) * (p + 1) / 2) / nullif(CAST(p AS DOUBLE) * (n - p), 0), 6) AS auc FROM (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE correct) AS p, sum(CASE WHEN correct THEN rk ELSE 0 END) AS rp FROM (
    SELECT source, correct, rank() OVER (PARTITION BY source ORDER BY confidence) + (count(*) OVER (PARTITION BY source, confidence) - 1) / CAST(2 AS DOUBLE) AS rk
    FROM (SELECT lower(trim(source)) AS source, correct, confidence FROM result_log WHERE correct IS NOT NULL AND confidence IS NOT NULL)) GROUP BY source)""")
def auc(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "result_log").where(F.col("correct").isNotNull() & F.col("confidence").isNotNull()).withColumn("source", F.lower(F.trim("source")))
    return C.auc(log, ["source"], "confidence", "correct").select("source", "n", F.round("auc", 6).alias("auc"))


@r.query("q_agg52_calibrated_delta", f"""
WITH g AS (SELECT 0.05::DOUBLE * pow(400.0::DOUBLE, i / {_POINTS - 1}.0::DOUBLE) AS t FROM range({_POINTS}) r(i) UNION SELECT 1.0),
n AS (SELECT arm, t, {_NLL_T} AS nll FROM ({_S}) CROSS JOIN g WHERE split = 'calibration' GROUP BY ALL), f AS (SELECT arm, arg_min(t, nll) AS t FROM n GROUP BY arm),
x AS (SELECT arm, avg(nll) AS raw FROM ({_ITEMS}) WHERE split = 'test' GROUP BY arm),
y AS (SELECT s.arm, {_NLL_T} AS cal FROM ({_S}) s JOIN f ON f.arm = s.arm WHERE split = 'test' GROUP BY s.arm)
SELECT x.arm, round(raw, 5) AS raw_nll, round(cal, 5) AS calibrated_nll FROM x JOIN y ON x.arm = y.arm""")
def calibrated_delta(spark: SparkSession, sf: str) -> DataFrame:
    """NLL on test before and after the temperature fitted on calibration."""
    s = views.scores(spark, sf)
    fit = C.temperature_fit(s.where(F.col("split") == "calibration"), ["arm"], points=_POINTS).select("arm", "temperature")
    test = s.where(F.col("split") == "test").join(F.broadcast(fit), "arm")  # one row per arm
    out = test.groupBy("arm").agg(F.round(F.avg(V.nll(F.col("z"), F.col("gold"))), 5).alias("raw_nll"), F.round(F.avg(V.nll(V.scaled(F.col("z"), F.col("temperature")), F.col("gold"))), 5).alias("calibrated_nll"))
    return out


_FIRST = "list_position({0}, list_max({0}))"


@r.query("q_gat10_argmax_kept", f"""
WITH g AS (SELECT 0.05::DOUBLE * pow(400.0::DOUBLE, i / {_POINTS - 1}.0::DOUBLE) AS t FROM range({_POINTS}) r(i) UNION SELECT 1.0),
n AS (SELECT arm, t, {_NLL_T} AS nll FROM ({_S}) CROSS JOIN g WHERE split = 'calibration' GROUP BY ALL), f AS (SELECT arm, arg_min(t, nll) AS t FROM n GROUP BY arm),
x AS (SELECT s.arm, z, list_transform(z, lambda v: v / f.t) AS scaled FROM ({_S}) s JOIN f ON f.arm = s.arm)
SELECT arm, count(*) AS n, count(*) FILTER (WHERE {_FIRST.format('z')} <> {_FIRST.format('scaled')}) AS moved, CASE WHEN count(*) FILTER (WHERE {_FIRST.format('z')} <> {_FIRST.format('scaled')}) > 0 THEN 'fail' ELSE 'pass' END AS status FROM x GROUP BY arm""")
def argmax_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Scaling by the temperature fitted for an arm must not change any prediction of it."""
    s = views.scores(spark, sf)
    fit = C.temperature_fit(s.where(F.col("split") == "calibration"), ["arm"], points=_POINTS).select("arm", "temperature")
    moved = C.argmax_moved(s.join(F.broadcast(fit), "arm"), ["arm"], F.col("temperature"))  # one row per arm
    return moved.withColumn("status", F.when(F.col("moved") > 0, "fail").otherwise("pass"))


@r.query("q_agg23_bootstrap_mean")
def bootstrap_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of each arm with its interval from 10,000 replicates over families."""
    return B.bootstrap_mean(C.items(views.scores(spark, sf)), ["arm"], "group_id", F.col("correct").cast("double"), seed="b1")


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.items(views.scores(spark, sf)).select("arm", "id", "group_id", "correct")
    base = rows.where(F.col("arm") == 0).select("id", F.col("correct").alias("was"))
    return rows.where(F.col("arm") > 0).join(base, "id").select("arm", "group_id", (F.col("correct") - F.col("was")).cast("double").alias("d"))


@r.query("q_agg24_bootstrap_difference")
def bootstrap_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Each arm against arm 0 on the same items, families resampled together, 10,000 replicates."""
    return B.bootstrap_mean(_differences(spark, sf), ["arm"], "group_id", F.col("d"), seed="b2").drop("n_groups", "degenerate")


@r.query("q_agg26_bootstrap_nearest_rank")
def bootstrap_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals by nearest rank from 2,000 replicates."""
    rows = C.items(views.scores(spark, sf))
    return B.interval_nearest_rank(B.replicates_of_mean(rows, ["arm"], "group_id", F.col("correct").cast("double"), 2_000, "b3"), ["arm"])


@r.query("q_agg25_bootstrap_statistic")
def bootstrap_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of a statistic that is no mean: the calibration error of each arm, 10,000 replicates."""
    rows = C.items(views.scores(spark, sf)).withColumn("bin", C.bin_of(F.col("pmax")))
    reps = B.replicates_of_ece(rows, ["arm"], "group_id", F.col("bin"), F.col("correct").cast("double"), F.col("pmax"), C.BINS, seed="b4")
    return C.ece(rows, ["arm"]).join(B.interval(reps, ["arm"]), "arm")


@r.query("q_agg23_bootstrap_large")
def bootstrap_large(spark: SparkSession, sf: str) -> DataFrame:
    """10,000 replicates over the families (orders) of lineitem."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_linestatus") == "O").cast("double").alias("ok"))
    return B.bootstrap_mean(rows, ["l_returnflag"], "l_orderkey", F.col("ok"), seed="b5")


@r.query("q_agg45_permutation_flips", f"""
SELECT arm, count(*) AS n, count(*) FILTER (WHERE p <> q) AS flips, round(1 - count(*) FILTER (WHERE p <> q) / CAST(count(*) AS DOUBLE), 6) AS consistency FROM (
  SELECT arm, id, list_position(z, list_max(z)) - 1 AS p, (list_position(list_concat(z[4:], z[1:3]), list_max(z)) - 1 + 3) % 10 AS q FROM ({_S})) GROUP BY arm""")
def permutation_flips(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions on rotated options, mapped back: how many flip."""
    z = F.col("z")
    turned = F.concat(F.slice(z, 4, 7), F.slice(z, 1, 3))
    rows = views.scores(spark, sf).select("arm", V.first_argmax(z).alias("p"), ((V.first_argmax(turned) + 3) % 10).alias("q"))
    flips, n = F.count_if(F.col("p") != F.col("q")), F.count(F.lit(1))
    return rows.groupBy("arm").agg(n.alias("n"), flips.alias("flips"), F.round(1 - flips / n, 6).alias("consistency"))


@r.query("q_agg54_source_bundle", f"""
SELECT arm, source, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(pmax), 6) AS mean_pmax, mode_pred FROM (
  SELECT *, first_value(pred) OVER (PARTITION BY arm, source ORDER BY k DESC, pred) AS mode_pred FROM (SELECT *, count(*) OVER (PARTITION BY arm, source, pred) AS k FROM ({_ITEMS}))) GROUP BY ALL""")
def source_bundle(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.items(views.scores(spark, sf))
    per = rows.groupBy("arm", "source", "pred").agg(F.count(F.lit(1)).alias("k"), F.sum("correct").alias("ok"), F.sum("nll").alias("nll"), F.sum("pmax").alias("pmax"))
    n = F.sum("k")
    out = per.groupBy("arm", "source").agg(n.alias("n"), (F.sum("ok") / n).alias("accuracy"), (F.sum("nll") / n).alias("nll"), (F.sum("pmax") / n).alias("mean_pmax"), F.min(F.struct((-F.col("k")).alias("k"), "pred"))["pred"].alias("mode_pred"))
    return out.select("arm", "source", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "nll", "mean_pmax")], "mode_pred")


QUERIES, SQL = r.queries, r.sql
