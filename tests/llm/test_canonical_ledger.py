from datetime import datetime

from assayer.llm import ledger
from assayer.llm.canonical import canonical, canonical_words


def test_fields_in_any_order_arrays_in_theirs():
    a = '{"Policy": "A b!", "facts": {"x": 1, "y": [1, "two"]}}'
    b = '{ "facts": {"Y": [1, "TWO"], "X": 1},\n "policy": "a, B" }'
    assert canonical(a) == canonical(b) == "facts x 1 y 1 two policy a b"
    assert canonical(a) != canonical(a.replace('[1, "two"]', '["two", 1]'))


def test_lines_and_text():
    assert canonical("Channel: fax\r\nFrom: Ab-C") == canonical("FROM :  ab c\n\n channel: “Fax”") == "channel fax from ab c"
    assert canonical("from ab c channel fax") != canonical("Channel: fax\nFrom: Ab C")
    assert canonical("Note: one line only") == "note one line only"
    assert canonical("A  b\xa0c – d") == "a b c d"


def test_labels_of_any_length_are_fields():
    long = " ".join(["label"] * 40)
    assert canonical(f"{long}: a\nOther: b") == canonical(f"Other: b\n{long}: a")


def test_odd_texts():
    assert canonical(None) is None
    assert canonical("") == canonical(" -- \n") == ""
    assert canonical('{"a": tru') == "a tru"
    assert canonical('{"a": null, "b": true, "c": 1.50}') == "a null b true c 1 50"
    assert canonical('{"a": 1, "a": 2}') == "a 1 2"
    deep = '{"a":' * 30000 + "1" + "}" * 30000
    assert canonical_words(deep)[:2] == ["a", "a"]
    assert len(canonical_words("word " * 300_000)) == 300_000
    assert canonical("STRASSE") == canonical("straße")


T = [datetime(2026, 1, d, 5) for d in range(1, 6)]
ROWS = [
    ("b", "Hello  World", T[1], 1), ("a", "hello, world!", T[2], 2), ("c", '{"x": 1, "y": 2}', T[0], 3), ("d", '{"Y":2,"X":1}', T[4], 4),
    ("a", "hello world", T[4], 5), ("e", None, T[0], 6), (None, "hello world", T[0], 7), ("f", "", T[0], 8), ("g", "...", T[4], 9), ("h", "alone", None, 10), ("h", "alone", T[4], 10),
]
SCHEMA = "id string, state string, ingested_at timestamp, n_ids int"


def classes(led):
    return {(r["keep_id"], r["first_id"], r["n_ids"], r["n_rows"]) for r in led.all_classes().collect()}


def test_ledger_by_batches_equals_one_batch(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    whole = ledger.Ledger(spark, 4).fold(ledger.keyed(rows))
    led = ledger.Ledger(spark, 4)
    for i in range(0, len(ROWS), 5):
        led = led.fold(ledger.keyed(spark.createDataFrame(ROWS[i : i + 5], SCHEMA)))
    expected = {("a", "b", 2, 3), ("c", "c", 2, 2), ("f", "f", 2, 2), ("h", "h", 1, 2)}
    assert classes(whole) == classes(led) == classes(ledger.build(rows, 4)) == expected
    dups = {tuple(r) for r in ledger.duplicates(led).collect()}
    assert dups == {("a", "b"), ("c", "d"), ("f", "g")}


def test_untouched_buckets_stay_where_they_are(spark):
    led = ledger.Ledger(spark, 16).fold(ledger.keyed(spark.createDataFrame([(str(i), f"text {i}", T[0], 0) for i in range(40)], SCHEMA)))
    more = led.fold(ledger.keyed(spark.createDataFrame([("z", "text 3", T[1], 0)], SCHEMA)))
    assert sum(led.classes[b] != more.classes[b] for b in led.classes) == 1
    assert {tuple(r) for r in ledger.duplicates(more).collect()} == {("3", "z")}


def test_another_process_folds_on(spark, tmp_path):
    """A ledger saved by its manifest is opened by another session, which folds a batch; the first one reads the result."""
    import os
    import subprocess
    import sys

    rows = spark.createDataFrame(ROWS, SCHEMA)
    path = ledger.Ledger(spark, 4).fold(ledger.keyed(rows.where("n_ids < 6"))).save()
    rest = tmp_path / "rest"
    rows.where("n_ids >= 6").write.parquet(str(rest))
    code = f"""
from assayer.llm import ledger
from assayer.plans.session import local_session
spark = local_session(2, "other", **{{"spark.checkpoint.dir": "{tmp_path}/shared"}})
led = ledger.Ledger.open(spark, "{path}").fold(ledger.keyed(spark.read.parquet("{rest}")))
print("PATH", led.save())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": os.getcwd()}, check=True).stdout
    led = ledger.Ledger.open(spark, next(x.split()[1] for x in out.splitlines() if x.startswith("PATH")))
    whole = ledger.Ledger(spark, 4).fold(ledger.keyed(rows))
    assert classes(led) == classes(whole) and led.rows == whole.rows


def test_buckets_follow_the_size(spark):
    text = lambda ids: ledger.keyed(spark.createDataFrame([(f"{i:03}", f"Text {i % 90}", T[i % 5], 0) for i in ids], SCHEMA))
    led = ledger.Ledger(spark, 2).fold(text(range(60)), 20)
    assert led.buckets == 4 and led.rows == 60
    led = led.fold(text(range(60, 200)), 20)
    assert led.buckets == 16 and led.rows == 200 and len(led.members) > 8
    assert classes(led) == classes(ledger.Ledger(spark, 2).fold(text(range(200))))
    assert led.fold(text([])) is led


def test_empty_and_hot(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ledger.build(empty, 4).all_classes().count() == 0
    assert ledger.duplicates(ledger.build(empty, 4)).count() == 0
    hot = spark.createDataFrame([(f"{i:04}", "Same" if i % 3 == 0 else f"t {i}", T[i % 5], 0) for i in range(900)], SCHEMA)
    assert ledger.duplicates(ledger.build(hot, 4)).count() == 299
