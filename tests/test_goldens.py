import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import vectors as V
from assayer.functions.text import content_hash, normalized, normalized_exact
from assayer.operators import calibration, classify, options, paired, resample


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_form(spark):
    a, b = "Return window is 30 days! Purchase was 12 days ago.", "return   WINDOW is 30 days… purchase WAS 12 days ago"
    golden = "4cbf80303f1cf59559d59d963742728b70719ac0e2df84daee886e0cfc6c0635"
    r = one(spark, *[content_hash(F.lit(x), exact).alias(f"c{i}{exact}") for i, x in enumerate((a, b)) for exact in (False, True)])
    assert set(r) == {golden}
    r = one(spark, normalized_exact(F.lit("ﬁn ＡＢ Straße")).alias("x"), normalized(F.lit("Straße_1 ÄÖ")).alias("y"), normalized_exact(F.lit(None).cast("string")).alias("z"))
    assert tuple(r) == ("fin ab strasse", "strasse_1 äö", None)


def test_shift(spark):
    r = one(spark, *[options.shift_for(F.lit("abc"), F.lit(n)).alias(f"n{n}") for n in (2, 3, 5, 24, 1)])
    assert tuple(r) == (1, 2, 2, 20, None)


OPTIONS = "array<struct<label:string,key:string,description:string>>"


def test_rotation_and_rules(spark):
    o = [("A", "k1", "short."), ("B", "k2", "the longest description here."), ("C", "k3", "12/34/56")]
    df = spark.createDataFrame([(o,), ([],), (None,)], f"o {OPTIONS}")
    c = F.col("o")
    rows = df.select(options.rotated(c, F.lit(1)).alias("r"), options.longest_option(c).alias("l"), options.most_marked_option(c).alias("m"), options.labels_in_order(c).alias("ok"), options.key_of(c, F.lit("B")).alias("k"), options.label_of(c, F.lit("nope")).alias("n")).collect()
    first = rows[0]
    assert [(x["label"], x["key"]) for x in first["r"]] == [("A", "k2"), ("B", "k3"), ("C", "k1")]
    assert (first["l"], first["m"], first["ok"], first["k"], first["n"]) == ("B", "C", True, "k2", None)
    assert rows[1]["l"] is None and rows[2]["m"] is None


@pytest.mark.parametrize(("text", "letter"), [("A", "A"), (" B", "B"), ("A\n", "A"), ("a", None), ("AB", None), ("", None), ("The answer is A", None), ("A.", None), ("<think>x</think>A", None), ("答案是A", None), ("E", None), (None, None)])
def test_strict_letter(spark, text, letter):
    assert one(spark, options.strict_letter(F.lit(text).cast("string"), F.lit(4)).alias("x"))["x"] == letter


ITEMS = [([0.7, 0.2, 0.1], 0), ([0.1, 0.8, 0.1], 1), ([0.2, 0.3, 0.5], 2)]


def scores(spark, rows):
    return spark.createDataFrame([(1, i, [math.log(x) for x in p], g) for i, (p, g) in enumerate(rows)], "arm int, id int, z array<double>, gold int")


def test_nll_and_brier(spark):
    s = calibration.summary(calibration.items(scores(spark, ITEMS)), ["arm"]).first()
    assert s["nll"] == pytest.approx(0.424322, abs=1e-6) and s["brier"] == pytest.approx((0.14 + 0.06 + 0.38) / 3) and s["accuracy"] == 1


def test_ece(spark):
    rows = spark.createDataFrame([(1, 0.90, 1), (1, 0.80, 0), (1, 0.45, 0), (2, 1.0, 1)], "arm int, pmax double, correct int")
    got = {r["arm"]: r["ece"] for r in calibration.ece(rows, ["arm"], bins=2).collect()}
    assert got[1] == pytest.approx(1 / 3 * 0.45 + 2 / 3 * 0.35) and got[2] == 0


def test_selective(spark):
    rows = spark.createDataFrame([(1, 1, 0.7, 1), (1, 2, 0.8, 1), (1, 3, 0.5, 0)], "arm int, id int, pmax double, correct int")
    got = {r["coverage"]: (r["k"], r["accuracy"]) for r in calibration.selective(rows, ["arm"], (0.34, 1.0)).collect()}
    assert got == {0.34: (2, 1.0), 1.0: (3, pytest.approx(2 / 3))}


def test_extreme_temperature(spark):
    df = spark.createDataFrame([([0.0, -50.0], 1)], "z array<double>, gold int")
    r = df.select(V.softmax(V.scaled(F.col("z"), 20.0))[1].alias("p"), V.nll(V.scaled(F.col("z"), 20.0), F.col("gold")).alias("n"), V.nll(F.col("z"), F.col("gold")).alias("m")).first()
    assert r["p"] == pytest.approx(0.07585818, abs=1e-8) and r["n"] == pytest.approx(2.57889, abs=1e-5) and r["m"] == pytest.approx(50.0)


def test_temperature_is_that_of_the_whole_grid(spark):
    rng = np.random.default_rng(0)
    rows = []
    for arm, true in ((0, 2.5), (1, 0.6), (2, 1.0)):
        for i in range(300):
            k = 2 + i % 4
            z = rng.normal(0, 2, k)
            p = np.exp(z / true) / np.exp(z / true).sum()
            rows.append((arm, i, [float(x) for x in z], int(rng.choice(k, p=p))))
    df = spark.createDataFrame(rows, "arm int, id int, z array<double>, gold int")
    grid = np.array(calibration.grid_with_one(0.05, 20.0, 401))
    for r in calibration.temperature_fit(df, ["arm"], points=401, step=16).collect():
        mine = [(np.array(z), g) for a, _, z, g in rows if a == r["arm"]]
        nll = [np.mean([np.log(np.exp(z / t - (z / t).max()).sum()) + (z / t).max() - z[g] / t for z, g in mine]) for t in grid]
        assert r["temperature"] == pytest.approx(grid[int(np.argmin(nll))]) and not r["at_boundary"]


@pytest.mark.parametrize(("b", "c", "p"), [(115, 671, 2.940542125979947e-96), (1, 142, 2.582873e-41), (0, 13, 2.44140625e-4), (997, 962, 0.442390), (0, 0, 1.0), (5, 5, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, paired.mcnemar_exact(F.lit(b), F.lit(c)).alias("p"))["p"] == pytest.approx(p, rel=1e-6)


def test_chi2_and_wilson(spark):
    r = one(spark, paired.mcnemar_chi2(F.lit(115), F.lit(671)).alias("x"), paired.mcnemar_chi2(F.lit(0), F.lit(0)).alias("zero"))
    assert r["x"] == pytest.approx(391.89, abs=0.01) and r["zero"] == 0
    for k, lo, hi in ((1141, 0.5487, 0.5920), (1013, 0.4846, 0.5284), (1000, 0.4781, 0.5219)):
        r = one(spark, paired.wilson(F.lit(k), F.lit(2000), False).alias("lo"), paired.wilson(F.lit(k), F.lit(2000), True).alias("hi"))
        assert (round(r["lo"], 4), round(r["hi"], 4)) == (lo, hi)
    assert one(spark, paired.wilson(F.lit(0), F.lit(0), True).alias("x"))["x"] is None


def test_binary_rates(spark):
    rows = [(True, True)] * 142 + [(True, False)] * 857 + [(True, None)] + [(False, True)] * 1 + [(False, False)] * 999
    r = spark.createDataFrame(rows, "g boolean, p boolean").agg(*classify.binary_rates(F.col("g"), F.col("p"))).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (142, 858, 1, 999) and r["recall"] == pytest.approx(0.142) and r["fpr"] == pytest.approx(0.001)


def test_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "a")], "gold string, pred string")
    c = classify.per_class(df, ("a", "b", "c"), "gold", "pred")
    m = classify.macro(c).first()
    assert m["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 3) and m["macro_recall"] == pytest.approx(0.75) and m["n_defined"] == 2
    assert sum(r["n"] for r in classify.confusion(df, ("a", "b", "c"), "gold", "pred").collect()) == 3


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(0)
    rows = [(g, rng.choice([0.1, 0.2, 0.5, 0.9]), rng.random() < 0.4) for g in (1, 2) for _ in range(40)] + [(3, 0.5, True)]
    for r in calibration.auc(spark.createDataFrame(rows, "g int, s double, ok boolean"), ["g"], "s", "ok").collect():
        pos, neg = [s for g, s, k in rows if g == r["g"] and k], [s for g, s, k in rows if g == r["g"] and not k]
        pairs = [(p > n) + 0.5 * (p == n) for p in pos for n in neg]
        assert r["auc"] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(1, f"g{i // 2}", float(v)) for i, v in enumerate((1, 1, 0, 1, 0, 0, 1, 1))] + [(2, "x", 1.0), (2, "y", 1.0)], "arm int, g string, v double")
    a, b = (sorted(map(tuple, resample.bootstrap_mean(rows, ["arm"], "g", F.col("v"), 50, "s").collect())) for _ in range(2))
    assert a == b and a[0][1] == 0.625 and a[0][2] <= 0.625 <= a[0][3] and a[0][4] == 4
    assert a[1][1:4] == (1.0, 1.0, 1.0) and a[1][5] is True
    fam = resample.families(rows, ["arm"], "g", {"s": F.col("v")})
    assert resample.replicates_of_ratio(fam, ["arm"], "s", 10, "s").count() == 20
    total = resample.draws(fam, ["arm"], 7, "s").groupBy("arm", "b").agg(F.sum("weight").alias("w")).collect()
    assert {(r["arm"], r["w"]) for r in total} == {(1, 4), (2, 2)}


def test_poisson_weights():
    import numpy as np

    assert resample.poisson_table().mean() == 1.0
    w = resample.weights(np.arange(400, dtype=np.int64), 999)
    assert w.shape == (400, 999) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.array_equal(w[7], resample.weights(np.array([7], np.int64), 999)[0])
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_replicates_against_plain_numpy(spark):
    """The same weights by hand, families in any layout; and the interval against the exact scheme."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(1 + i % 2, f"g{i // 3}", float(rng.random() < 0.6), float(rng.random()), i % 5) for i in range(600)] + [(1, None, 1.0, 0.5, 0)]
    rows = spark.createDataFrame(data, "arm int, g string, v double, p double, k int").repartition(3)
    got = {(r["arm"], r["b"]): r for r in resample.replicate_sums(rows, ["arm"], "g", {"s": F.col("v")}, 50, "t").collect()}
    hashes = {r["g"]: r["h"] for r in rows.select("g", F.xxhash64(F.lit("t"), F.col("g")).alias("h")).distinct().collect()}
    w = {g: resample.weights(np.array([h], np.int64), 50)[0] for g, h in hashes.items()}
    for arm in (1, 2):
        s, n = (sum(w[g] * (v if x else 1.0) for a, g, v, *_ in data if a == arm) for x in (1, 0))
        assert all(got[arm, b]["s"] == s[b] and got[arm, b]["n"] == n[b] for b in range(50))
    ci = resample.bootstrap_mean(rows.where("arm = 2"), ["arm"], "g", F.col("v"), 4000, "u").first()
    fam = {}
    for a, g, v, *_ in data:
        if a == 2:
            fam.setdefault(g, []).append(v)
    pairs = np.array([(sum(x), len(x)) for x in fam.values()])
    exact = pairs[rng.integers(0, len(pairs), (4000, len(pairs)))].sum(axis=1)
    lo, hi = np.percentile(exact[:, 0] / exact[:, 1], [2.5, 97.5])
    assert abs(ci["lo"] - lo) < 0.01 and abs(ci["hi"] - hi) < 0.01
    ece = resample.replicates_of_ece(rows, ["arm"], "g", F.col("k"), F.col("v"), F.col("p"), 5, 20, "t").where("arm = 1 and b = 4").first()["m"]
    sums = {k: sum(w[g][4] * (v - q) for a, g, v, q, kk in data if a == 1 and kk == k) for k in range(5)}
    assert ece == pytest.approx(sum(map(abs, sums.values())) / sum(w[g][4] for a, g, *_ in data if a == 1))
    empty = resample.replicate_sums(rows.limit(0), ["arm"], "g", {"s": F.col("v")}, 10, "t")
    assert empty.count() == 0


def test_mcnemar_of_any_size(spark):
    """Bounded sums agree with whole ones; beyond, the normal tail continues them."""
    import math

    def plain(b, c):
        n, k = b + c, min(b, c)
        t = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * sum(map(math.exp, t)))

    for b, c in ((20_000, 20_300), (9_000, 9_000), (60_000, 61_000), (250_000, 251_500)):
        assert one(spark, paired.mcnemar_exact(F.lit(b), F.lit(c)).alias("p"))["p"] == pytest.approx(plain(b, c), rel=2e-3)
    assert one(spark, paired.mcnemar_exact(F.lit(10**11), F.lit(10**11)).alias("p"))["p"] == pytest.approx(1, abs=1e-5)
