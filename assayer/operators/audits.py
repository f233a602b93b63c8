"""Gates as data: every check is a row (check, subject, n_bad, status); enforcing is a separate act.

A check over nothing is 'unchecked', never 'pass'.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    pass


def counted(rows: DataFrame, check: str, bad: Column, subject: str | None = None) -> DataFrame:
    """One check over rows: how many are bad, per subject."""
    by = F.col(subject).cast("string") if subject else F.lit("all")
    return rows.groupBy(by.alias("subject")).agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"), F.count(F.lit(1)).alias("n_seen")).select(F.lit(check).alias("check"), "subject", "n_bad", "n_seen")


def many(rows: DataFrame, checks: dict[str, Column], subject: str | None = None) -> DataFrame:
    """Many checks in one pass over rows."""
    by = F.col(subject).cast("string") if subject else F.lit("all")
    per = rows.groupBy(by.alias("subject")).agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(k) for k, bad in checks.items()], F.count(F.lit(1)).alias("__seen__"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks])).alias("p")
    return per.select(pairs, "subject", F.col("__seen__").alias("n_seen")).select("p.check", "subject", "p.n_bad", "n_seen")


def report(*checks: DataFrame) -> DataFrame:
    all_ = reduce(DataFrame.unionByName, checks)
    status = F.when(F.col("n_seen") == 0, "unchecked").when(F.col("n_bad") > 0, "fail").otherwise("pass")
    return all_.withColumn("status", status)


def enforce(reported: DataFrame, allow_unchecked: bool = False) -> None:
    """Raises with the first failures if any check did not pass."""
    bad = reported.where(F.col("status") != "pass") if not allow_unchecked else reported.where(F.col("status") == "fail")
    if first := bad.orderBy("check", "subject").take(20):
        raise GateError("; ".join(f"{r['check']}[{r['subject']}]: {r['n_bad']} bad of {r['n_seen']}, {r['status']}" for r in first))


def arm_checks(results: DataFrame, arms: Sequence[str], expected: DataFrame) -> DataFrame:
    """Completeness of arms against the expected (id, source): ids missing, foreign or repeated, other source, other prompts.

    expected must hold each id once.
    """
    per = results.groupBy("arm", "id").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"), F.min("prompt_sha256").alias("prompt"))
    want = expected.select("id", F.col("source").alias("want_source")).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    j = want.join(per, ["arm", "id"], "full_outer")
    first = per.groupBy("id").agg(F.count_distinct("prompt").alias("prompts"))
    here = F.col("n").isNotNull()
    checks = many(
        j,
        {
            "missing": ~here,
            "foreign": F.col("want_source").isNull(),
            "repeated": here & (F.col("n") > 1),
            "source": here & F.col("want_source").isNotNull() & ~F.equal_null("source", "want_source"),
            "no_fingerprint": here & F.col("prompt").isNull(),
        },
        "arm",
    )
    return report(checks, counted(first, "prompts_differ", F.col("prompts") > 1))


def run_checks(results: DataFrame, registry: dict[str, str], arm: str = "arm", model: str = "model") -> DataFrame:
    """Each arm must have one model, the registered one, and every registered arm must be there."""
    known = F.create_map(*[F.lit(x) for kv in sorted(registry.items()) for x in kv]) if registry else F.create_map().cast("map<string,string>")
    rows = results.select(F.col(arm).alias("arm"), F.col(model).alias("model")).withColumn("want", F.try_element_at(known, F.col("arm")))
    per = rows.groupBy("arm").agg(F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("n"))
    missing = per.agg(F.collect_set("arm").alias("arms")).select(F.explode(F.array(*map(F.lit, sorted(registry)))).alias("arm"), "arms")  # one entry per arm
    return report(
        many(rows, {"unregistered_arm": F.col("want").isNull(), "other_model": F.col("want").isNotNull() & ~F.equal_null("model", "want")}, "arm"),
        counted(per, "several_models", F.col("models") > 1, "arm"),
        counted(missing, "absent_arm", ~F.array_contains("arms", F.col("arm")), "arm"),
    )


def manifest(rows: DataFrame, by: str, columns: dict[str, Column], text: Column) -> DataFrame:
    """(by, n_rows, distinct counts, digest): what a rebuild is checked against; the digest is a sum of hashes, so order does not matter."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(k) for k, c in columns.items()], F.sum(number).cast("string").alias("digest"))


def against_manifest(found: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Checks of a rebuilt manifest against the kept one: a line that is missing or foreign, and every field that differs."""
    fields = [c for c in expected.columns if c != by]
    a = expected.select(F.struct(by).alias("k"), F.struct(*fields).alias("a"))
    b = found.select(F.struct(by).alias("k"), F.struct(*fields).alias("b"))
    j = a.join(b, "k", "full_outer").withColumn("subject", F.coalesce(F.col(f"k.{by}").cast("string"), F.lit("none")))
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    checks = {"missing": F.col("b").isNull(), "foreign": F.col("a").isNull()} | {c: here & ~F.equal_null(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in fields}
    return report(many(j, checks, "subject"))


def same_builds(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right, n_left): rows, as multisets, that only one of two builds holds."""
    b = b.select(*a.columns)
    only = a.exceptAll(b).select(F.lit("l").alias("side")).unionByName(b.exceptAll(a).select(F.lit("r").alias("side"))).unionByName(a.select(F.lit("n").alias("side")))
    return only.agg(*[F.count_if(F.col("side") == k).alias(name) for k, name in (("l", "only_left"), ("r", "only_right"), ("n", "n_left"))])


def bundle(checks: dict[str, DataFrame]) -> DataFrame:
    """(gate, n_bad, n_seen, status) of many reports: a gate passes if all its checks do, and ``all`` if every gate does."""
    parts = [c.agg(F.sum("n_bad").alias("n_bad"), F.sum("n_seen").alias("n_seen")).select(F.lit(k).alias("gate"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("n_seen", F.lit(0)).alias("n_seen")) for k, c in checks.items()]
    each = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("n_seen") == 0, "unchecked").when(F.col("n_bad") > 0, "fail").otherwise("pass")
    each = each.withColumn("status", status)
    bad = F.count_if(F.col("status") != "pass")
    whole = each.agg(bad.alias("n_bad"), F.count(F.lit(1)).alias("n_seen")).select(F.lit("all").alias("gate"), "n_bad", "n_seen", F.when(F.col("n_bad") > 0, "fail").otherwise("pass").alias("status"))
    return each.unionByName(whole)


def write_failed(bundled: DataFrame, folder: str) -> bool:
    """Leaves FAILED.json with the gates that did not pass in the folder, if there are any; says whether all passed."""
    from assayer.plans.lineage import write_text

    bad = [r.asDict() for r in bundled.where((F.col("status") != "pass") & (F.col("gate") != "all")).orderBy("gate").collect()]  # one row per gate
    if bad:
        write_text(bundled.sparkSession, f"{folder}/FAILED.json", json.dumps(bad, sort_keys=True))
    return not bad


def self_check(found: DataFrame, published: DataFrame, key: Sequence[str], values: Sequence[str], within: float = 5e-7) -> DataFrame:
    """Checks that recomputed numbers reproduce the published ones; a number missing on either side fails."""
    j = found.select(*key, *[F.col(v).alias(f"{v}_found") for v in values]).join(published, list(key), "full_outer")
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("subject")
    off = {v: F.abs(F.col(f"{v}_found") - F.col(v)) > within for v in values}
    return report(many(j.withColumn("__subject", subject), off, "__subject"))


def filled(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """rows with missing, null or empty identity columns filled; another value than the one meant makes ``conflicts`` non-zero."""
    for c, v in values.items():
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) if c in rows.columns else F.lit(v))
    return rows


def conflicts(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Checks that no row holds another identity than the one to be filled in."""
    there = {c: v for c, v in values.items() if c in rows.columns}
    return report(many(rows, {c: F.coalesce((F.col(c) != "") & (F.col(c) != v), F.lit(False)) for c, v in there.items()}))


def backfilled(rows: DataFrame, values: dict[str, str], path: str) -> DataFrame:
    """Validates all rows, then writes all filled rows, then reads them back and compares; raises before anything is written if a row conflicts."""
    from assayer.sources.sinks import verify_written

    enforce(conflicts(rows, values), allow_unchecked=True)
    out = filled(rows, values)
    out.write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.schema(out.schema).parquet(path)
    verify_written(out, back)
    return back


def allowed(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Checks that a column holds names of a closed list only."""
    return report(counted(rows, f"{column}_allowed", ~F.col(column).isin(*names), column))


def identity_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, problem) of two identities (field, value), compared both ways."""
    j = a.select("field", F.struct("value").alias("a")).join(b.select("field", F.struct("value").alias("b")), "field", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "foreign").when(~F.equal_null("a.value", "b.value"), "differs")
    return j.select("field", problem.alias("problem")).where(F.col("problem").isNotNull())
