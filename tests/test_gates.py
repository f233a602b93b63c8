"""Gates against planted violations."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assayer.functions.text import object_hashes
from assayer.operators import audits
from assayer.plans import skew
from assayer.plans.lineage import new_path, shared_dir
from assayer.sources import sinks
from assayer.streaming import answer_log


def bad(report):
    return {(r["check"], r["subject"]) for r in report.where("status <> 'pass'").collect()}


def test_runs(spark):
    rows = spark.createDataFrame([("a", "m1"), ("a", "m1"), ("b", "m2"), ("b", "m3"), ("c", None), ("d", "m9")], "arm string, model string")
    assert bad(audits.run_checks(rows, {"a": "m1", "b": "m2", "c": "m4", "e": "m5"})) == {("other_model", "b"), ("several_models", "b"), ("other_model", "c"), ("unregistered_arm", "d"), ("absent_arm", "e")}


def test_rebuild_against_manifest(spark):
    schema = "split string, id string, state string"
    rows = [("train", f"i{k}", f"s{k % 3}") for k in range(6)] + [(None, "n", "s")]
    of = lambda r: audits.manifest(spark.createDataFrame(r, schema), "split", {"states": F.col("state")}, F.concat_ws("|", "id", "state"))
    kept = of(rows)
    assert bad(audits.against_manifest(of(rows[::-1]), kept, "split")) == set()
    assert bad(audits.against_manifest(of([*rows[:-1], ("test", "x", "y")]), kept, "split")) == {("missing", "none"), ("foreign", "test")}
    assert bad(audits.against_manifest(of([("train", "i0", "other"), *rows[1:]]), kept, "split")) == {("digest", "train"), ("states", "train")}
    assert audits.against_manifest(of([]), of([]), "split").count() == 0


def test_bundle_and_failed(spark):
    good, broken = (audits.counted(spark.createDataFrame([(x,)], "x int"), "c", F.col("x") > 1) for x in (1, 2))
    nothing = audits.counted(spark.createDataFrame([], "x int"), "c", F.col("x") > 1)
    whole = audits.bundle({"good": good, "broken": broken, "nothing": nothing})
    assert {r["gate"]: r["status"] for r in whole.collect()} == {"good": "pass", "broken": "fail", "nothing": "unchecked", "all": "fail"}
    folder = new_path(spark, "audit")
    assert not audits.write_failed(whole, folder)
    told = json.loads(open(f"{folder.removeprefix('file:')}/FAILED.json").read())
    assert [x["gate"] for x in told] == ["broken", "nothing"]
    clean = new_path(spark, "audit")
    assert audits.write_failed(audits.bundle({"good": good}), clean) and not os.path.exists(clean.removeprefix("file:"))
    assert shared_dir(spark) in folder


def test_self_check(spark):
    found = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("d", 1.0)], "k string, v double")
    kept = spark.createDataFrame([("a", 0.5000004), ("b", 0.2500009), ("c", 1.0)], "k string, v double")
    assert bad(audits.self_check(found, kept, ["k"], ["v"])) == {("v", "b"), ("v", "c"), ("v", "d")}


def test_backfill(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "m")], "i int, model string")
    path = new_path(spark, "filled")
    back = audits.backfilled(rows, {"model": "m", "sha": "s"}, path)
    assert {tuple(r) for r in back.collect()} == {(i, "m", "s") for i in (1, 2, 3)}
    other = new_path(spark, "filled")
    with pytest.raises(audits.GateError):
        audits.backfilled(rows, {"model": "n"}, other)
    assert not os.path.exists(other.removeprefix("file:"))


def test_builds_and_lists(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "v int, k string")
    assert tuple(audits.same_builds(a, b).first()) == (1, 1, 3)
    assert bad(audits.allowed(a, "k", ["x"])) == {("k_allowed", "y")}


def test_identities(spark):
    of = lambda d: spark.createDataFrame(list(d.items()), "field string, value string")
    assert {tuple(r) for r in audits.identity_differences(of({"a": "1", "b": "2", "c": None}), of({"a": "1", "b": "3", "d": "4"})).collect()} == {("b", "differs"), ("c", "missing"), ("d", "foreign")}
    log = spark.createDataFrame([("b1", "m", "1"), ("b2", "n", "1")], "batch string, model string, seed string")
    assert {tuple(r) for r in answer_log.sidecar_problems(log, "batch", ["model", "seed"], {"model": "m", "arm": "x"}).collect()} == {("b1", "seed", "foreign"), ("b1", "arm", "missing"), ("b2", "model", "differs"), ("b2", "seed", "foreign"), ("b2", "arm", "missing")}
    done = answer_log.batches(spark.createDataFrame([("b1", "i", None), ("b1", "i", True), ("b2", "j", None)], "batch string, id string, ok boolean"), "batch", "id", F.col("ok").isNotNull())
    assert {r["batch"]: r["complete"] for r in done.collect()} == {"b1": True, "b2": False}


def test_object_hashes(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "x"}',), ('{ "a": "X", "b": 1 }',), ('{"a": "é"}',), ("[1]",), ("{broken",), (None,), ("",)], "t string")
    h = [r["h"] for r in rows.select(object_hashes("t").alias("h")).collect()]
    assert h[0]["plain"] == h[0]["ascii"] == h[1]["plain"] and h[2]["plain"] != h[2]["ascii"] and h[3:] == [None] * 4


def test_expand_holds_with_hot_keys(spark):
    members = spark.createDataFrame([("hot", f"m{i}") for i in range(400)] + [(f"k{i}", f"n{i}") for i in range(50)], "key string, m string")
    links = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("absent", 4)], "key string, l int")
    got = skew.expand(links, members, "key", least=20)
    assert got.count() == 801 and got.distinct().count() == 801 and set(got.columns) == {"key", "l", "m"}
    assert skew.expand(links.limit(0), members, "key").count() == 0 == skew.expand(links, members.limit(0), "key").count()


def test_join_in_parts(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [("none", 1), (None, 2)], "key string, id long")
    keyed = spark.createDataFrame([("hot", 400, "a"), ("k3", 1, "b"), ("k9", 0, "c"), ("absent", 5, "d")], "key string, n long, v string")
    got = skew.join_in_parts(rows, keyed, "key", "n", "id", 600)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted([(i, "a") for i in range(600) if i % 3] + [(3, "b"), (9, "c")])


def test_long_reports_say_so(spark):
    text = sinks.markdown(spark.range(5), most=3)
    assert "more rows than shown" in text and text.count("\n") == 6
    assert "more rows" not in sinks.markdown(spark.range(3), most=3)
