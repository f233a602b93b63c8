import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import audits, dedup, sampling, series, setops
from assayer.sources import jsonl, sinks
from assayer.streaming import answer_log


def test_setops(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert tuple(setops.overlap(a, b, "k").first()) == (2, 2, 1, 0, 1)
    assert tuple(setops.overlap(a.limit(0), b, "k").first()) == (0, 2, 0, 0, 0)
    assert {tuple(r) for r in setops.difference(a, b, "k").collect()} == {("x", "left"), (None, "left"), ("z", "right")}
    parent = spark.createDataFrame([(c,) for c in "abcd"], "k string")
    kids = [spark.createDataFrame([(c,) for c in s], "k string") for s in ("ab", "bz")]
    assert tuple(setops.conserved(parent, kids, "k").first()) == (4, 3, 1, 2, 1)
    d = lambda rows: setops.digest(spark.createDataFrame([(x,) for x in rows], "k string"), "k").first()
    assert d("abc") == d("cbaab") and d("abc") != d("abd")


def test_first_content_keeps_rows_without_content(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "n int, c string")
    assert sorted(r["n"] for r in dedup.first_content(df, F.col("c"), [F.col("n").asc()]).collect()) == [1, 2, 4, 5]


def test_sampling(spark):
    rows = spark.createDataFrame([("s" if i % 10 else "t", f"g{i // 3}", str(i)) for i in range(300)] + [("s", None, "x")], "source string, grp string, id string")
    held = sampling.holdout_groups(rows, "source", "grp", 0.05, "a").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in held} == {"s": 5, "t": 2}
    split = sampling.split_by_groups(rows, "source", "grp", 0.05, "a")
    assert split.count() == 301 and split.groupBy("source", "grp").agg(F.count_distinct("held").alias("k")).where("k > 1").isEmpty()
    assert sampling.sample(rows, 7, "a", "id").count() == 7
    assert [r["id"] for r in sampling.sample(rows, 7, "a", "id").collect()] == [r["id"] for r in sampling.sample(rows.repartition(5), 7, "a", "id").collect()]
    dealt = sampling.sequential_quotas(rows, "source", "grp", [("a", 2), ("b", 3)], "q").groupBy("source", "split").count().collect()
    assert {(r["source"], r["split"]): r["count"] for r in dealt} == {("s", "a"): 2, ("s", "b"): 3, ("t", "a"): 2, ("t", "b"): 3}


def test_series(spark):
    rows = [(1, s, float(s)) for s in range(1, 7) for _ in range(2)] + [(2, 1, 1.0), (2, 1, 1.0), (2, 3, float("nan"))]
    df = spark.createDataFrame(rows, "run int, step int, loss double")
    last = {r["run"]: r["last_mean"] for r in series.last_mean(df, "run", "step", "loss", 3).collect()}
    assert last == {1: 10.0, 2: None}
    assert {tuple(r) for r in series.validity(df, "run", "step", "loss", 2).collect()} == {(1, 0, 0, 0), (2, 1, 1, 1)}
    assert series.rolling_mean(df, "run", "step", "loss", 3).where("rolling is not null and run = 1").count() == 4


def test_planted_violations_are_found(spark):
    expected = spark.createDataFrame([(f"i{k}", "s") for k in range(4)], "id string, source string")
    good = [(a, f"i{k}", "s", "p" + str(k)) for a in ("x", "y") for k in range(4)]
    schema = "arm string, id string, source string, prompt_sha256 string"

    def failing(rows):
        rep = audits.arm_checks(spark.createDataFrame(rows, schema), ["x", "y"], expected)
        return {(r["check"], r["subject"]) for r in rep.where("status = 'fail'").collect()}

    assert failing(good) == set()
    assert failing(good[1:]) == {("missing", "x")}
    assert failing([*good, good[0]]) == {("repeated", "x")}
    assert failing([*good, ("x", "i9", "s", "p")]) == {("foreign", "x")}
    assert failing([("x", "i0", "t", "p0"), *good[1:]]) == {("source", "x")}
    assert failing([("x", "i0", "s", None), *good[1:]]) == {("no_fingerprint", "x")}
    assert failing([("x", "i0", "s", "other"), *good[1:]]) == {("prompts_differ", "all")}
    assert ("foreign", "z") in failing([*good, ("z", "i0", "s", "p0")])
    with pytest.raises(audits.GateError):
        audits.enforce(audits.arm_checks(spark.createDataFrame(good[1:], schema), ["x", "y"], expected))
    nothing = audits.report(audits.counted(expected, "c", F.lit(False)).withColumn("n_seen", F.lit(0)))
    with pytest.raises(audits.GateError):
        audits.enforce(nothing)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "state": "a b"}\n{"id": "2", "state": null}\n')
    rows = jsonl.read_jsonl(spark, str(p), jsonl.RECORD)
    assert [(r["id"], r["state"]) for r in rows.orderBy("id").collect()] == [("1", "a b"), ("2", None)]
    assert jsonl.read_bounded(spark, str(p), jsonl.RECORD, most_rows=2).count() == 2
    for limit in ({"most_rows": 1}, {"most_line": 5}, {"most_bytes": 9}, {"sha256": "0" * 64}):
        with pytest.raises(jsonl.SourceError):
            jsonl.read_bounded(spark, str(p), jsonl.RECORD, **limit)


def test_repaired(spark, tmp_path):
    good = '{"id": "1"}\n{"id": "2"}'
    for text, ids, problems in ((good, ["1", "2"], []), (good + "\n", ["1", "2"], []), (good + '\n{"id": "3', ["1", "2"], ["tail"]), ('{"id": "1"}\n{"id": \n{"id": "2"}', ["1", "2"], ["middle"])):
        p = tmp_path / "log.jsonl"
        p.write_text(text)
        rows, bad = jsonl.read_repaired(spark, str(p), jsonl.RECORD)
        assert sorted(r["id"] for r in rows.collect()) == ids and [r["problem"] for r in bad.collect()] == problems
        if "middle" in problems:
            with pytest.raises(jsonl.SourceError):
                jsonl.repaired_or_fail(spark, str(p), jsonl.RECORD)
        spark.catalog.clearCache()


def test_manifest_and_files(spark, tmp_path):
    p = tmp_path / "m.json"
    sinks.write_manifest({"b": 1, "a": {"x": None}}, str(p))
    assert jsonl.load_manifest(str(p)) == {"b": 1, "a": {"x": None}}
    p.write_text('{"a": 1, "a": 2}')
    with pytest.raises(jsonl.SourceError):
        jsonl.load_manifest(str(p))
    assert sinks.archived(str(p)).endswith("m.json.1") and not p.exists()
    (tmp_path / "set.txt").write_text(" b \n\na\nb\n")
    assert sorted(r["value"] for r in jsonl.read_set(spark, str(tmp_path / "set.txt")).collect()) == ["a", "b"]
    (tmp_path / "p.tsv").write_text("a\tb\tc\na\tb\tc\nnone\n")
    assert [tuple(r) for r in jsonl.read_pairs(spark, str(tmp_path / "p.tsv"), "x", "y").collect()] == [("a", "b\tc")]
    tree = tmp_path / "tree" / "records"
    tree.mkdir(parents=True)
    for n in ("a", "skip"):
        (tree / f"{n}.jsonl").write_text(json.dumps({"id": n}) + "\n")
    assert [r["id"] for r in jsonl.read_tree(spark, str(tmp_path / "tree"), "*.jsonl", jsonl.RECORD, "skip").collect()] == ["a"]
    (tmp_path / "arr.json").write_text('[{"id": "1"},\n {"id": "2"}]')
    assert jsonl.read_json_array(spark, str(tmp_path / "arr.json"), jsonl.RECORD).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b|c", None, None)], "k string, n int, v double")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_jsonl(df, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "out"))
    sinks.verify_written(df, back)
    with pytest.raises(sinks.SinkError):
        sinks.verify_written(df, back.limit(1))
    assert sinks.markdown(df) == "| k | n | v |\n|---|---|---|\n| a | 1 | 0.5000 |\n| b\\|c | – | – |\n"
    assert sinks.nested(df, ["k"], ["n"])["a"] == {"n": 1}
    sinks.append_ledger(df, str(tmp_path / "ledger"))
    sinks.append_ledger(df, str(tmp_path / "ledger"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ledger")).count() == 4


LOG = "id string, log_pos long, correct boolean, source string, model string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"i{k % 20}", k, [True, False, None][(k * 7) % 3], f"s{k % 2}", "m") for k in range(60)]
    df = spark.createDataFrame(rows, LOG)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = answer_log.CompactedTable(spark, str(tmp_path / "table"), df.schema, 4)
    answer_log.compact_stream(stream, target, str(tmp_path / "cp"), {"model": "m"}).awaitTermination()
    assert {tuple(r) for r in target.read().collect()} == {tuple(r) for r in dedup.compacted(df).collect()}
    assert answer_log.unfinished(df.select("id").distinct(), df).count() == len({r[0] for r in rows} - {r[0] for r in rows if r[2] is not None})


def test_identity_gate(spark):
    df = spark.createDataFrame([("a", 1, True, "s", "m"), ("b", 2, True, "s", None), ("c", 3, True, "s", "other")], LOG)
    with pytest.raises(answer_log.IdentityError, match="model: 2"):
        answer_log.check_identity(df, {"model": "m"})
    answer_log.check_identity(df.where("model = 'm'"), {"model": "m"})


def test_stalled(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS k, timestamp'2026-01-01 00:00:00' AS at UNION ALL SELECT 'a', timestamp'2026-01-01 00:30:00' UNION ALL SELECT 'b', timestamp'2026-01-01 00:01:00' UNION ALL SELECT 'b', timestamp'2026-01-01 00:05:00'")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = answer_log.stalled(stream, "k", "at", 10).writeStream.format("memory").queryName("stalled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["k"], r["gap_minutes"]) for r in spark.table("stalled").collect()] == [("a", 30.0)]
