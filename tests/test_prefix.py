import random

from pyspark.sql import functions as F

from assayer.plans.prefix import numbered, with_prefix_sums


def test_against_one_task(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(5)
    got = {(r["g"], r["k"]): (r["v_before"], r["v_all"]) for r in with_prefix_sums(df, ["g"], [F.desc("k")], {"v": F.col("v")}).collect()}
    for g, k, _ in rows:
        assert got[g, k] == (sum(x for h, j, x in rows if h == g and j > k), sum(x for h, _, x in rows if h == g))
    n = {r["k"]: (r["rn"], r["n"]) for r in numbered(df, [], [F.col("k").asc()]).collect()}
    assert n == {i: (i + 1, 900) for i in range(900)}
    assert numbered(df.limit(0), ["g"], [F.col("k").asc()]).count() == 0
