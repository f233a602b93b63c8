import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import residue
from assayer.llm.residue_rules import Judge, key_is_residue
from assayer.llm.tokens import WordHash, flat

JUDGE = Judge()


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ customer.name }}, we regret", "What do @@due_date@@ rules say", "Pick the %outcome_text% queue", "the [policy_body] rule", "[YOUR NAME] wrote", "give {0} back", "a <order_ref> b",
        "[Betrag einfügen] fehlt", "【此处填写】的清单", "It was ________ then", "[object Object] said", "TODO: write the second reason", "404 Not Found", "PAGE NOT FOUND (AB-12)", "Bitte aktivieren Sie JavaScript.",
        "请启用 JavaScript 后重试。", "The desk closed. Oops! That link is broken X", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "Velit quis amet nulla veniam labore mirem tempor", "placeholder text", "n/a n/a n/a n/a", "Something went wrong (IN-151966)", "Access denied",
    ],
)
def test_residue(text):
    assert JUDGE(text)[0] is not None


@pytest.mark.parametrize(
    "text",
    [
        "The template asks to write the name in <angle> brackets.", "Copied the set { 9, 2767 } into the claim [sic] on summer.", "paid < 6800 units, i.e. 9% of it", "The page was not found in the monthly tariff, wrote X",
        "The course on JavaScript was confirmed twice", "Access denied by the desk", "Something went wrong with it", "Service was unavailable", "see [12] and (Smith 2019)", "To be decided by a person", "Which error page did the writer see?", "A sample text of 5 parsers", "", "  ", "50% or $5 & #3", "THE SET { 39, 8426 } [SIC] IN <ANGLE> BRACKETS",
    ],
)
def test_no_residue(text):
    assert JUDGE(text)[0] is None


@pytest.mark.parametrize("text", ["[Your Name] wrote", "Dear [Client Name]", "on [Insert date here]", "[Date]", "for <Name>", "{Customer} asked", "(write your answer here)", "This page requires JavaScript", "410 Gone", "JavaScript must be enabled here"])
def test_residue_in_any_case_and_form(text):
    assert JUDGE(text)[0] is not None


def test_keys():
    assert key_is_residue("tbd_3") and key_is_residue("{key_0}") and not key_is_residue("close_form_3") and not key_is_residue("")


def test_placeholders_are_not_trusted():
    assert JUDGE("{desk}") == ("placeholder", False)
    assert JUDGE("Something went wrong")[1] and not JUDGE("Case closed on Monday by all of the desks. Something went wrong")[1]
    assert JUDGE("Something went wrong (KF-419967)")[1] and JUDGE("Database connection failed ref 4cea6bdbc489")[1]


def test_segments():
    assert residue.segments('{"a": "x", "b": ["y", {"c": " "}], "n": 3}') == ["x", "y"]
    assert residue.segments("A: x\nB: y") == [" x", " y", "A: x\nB: y"]
    assert residue.segments("plain: text") == ["plain: text"] and residue.segments("") == [] and residue.segments("{broken") == ["{broken"]


def test_simhash_is_near_for_near_texts():
    a = "we are sorry but the page that you were looking for has moved to another place on this site so please try again later today".split()
    texts = [a, a[:-1] + ["tomorrow"], a[::-1], []]
    sketch = lambda ts: residue.simhash(*residue.distinct_shingles(*flat(ts, WordHash())))
    s = sketch(texts)
    bits = [int(np.unpackbits(s[0] ^ x).sum()) for x in s]
    assert bits[0] == 0 and bits[1] <= residue.HAMMING < bits[2]
    assert all(np.array_equal(sketch([t])[0], x) for t, x in zip(texts, s, strict=True))
    assert residue.similarity(" ".join(a), " ".join(a)) == 1.0


@pytest.mark.parametrize("size", [8, 9, 12, 20, 30, 100, 400])
def test_recall_of_the_tables(size):
    """Pairs with Jaccard 0.8 to 0.9, the hard ones: nine tenths at least agree in a block and lie within the radius."""
    rng, pairs = random.Random(size), []
    while len(pairs) < 200:
        a = [f"w{rng.randrange(5000)}" for _ in range(size)]
        b = list(a)
        for _ in range(rng.randrange(1, 2 + size // 25)):
            i = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
            b[i : i + rng.randrange(2)] = [f"x{rng.randrange(5000)}"][: rng.randrange(2)]
        if residue.SIMILARITY <= residue.similarity(" ".join(a), " ".join(b)) <= (0.9 if size > 12 else 0.999):
            pairs.append((a, b))
    x, y = (residue.simhash(*residue.distinct_shingles(*flat(side, WordHash()))) for side in zip(*pairs, strict=True))
    meet = (x.view(np.uint16) == y.view(np.uint16)).any(axis=1) & (np.unpackbits(x ^ y, axis=1).sum(axis=1) <= residue.HAMMING)
    assert meet.mean() >= 0.9


OPTION = "array<struct<label:string,key:string,description:string>>"


def test_records(spark):
    notice = "please enable javascript to continue " + " ".join(f"then{i}" for i in range(3))
    rows = [
        ("ok", '{"note": "All is well", "keywords": ["desk"]}', "What is it?", [("A", "close_1", "N/A under the rules")], 1),
        ("ph", "Text with {desk} here", None, None, 1),
        ("opt", None, None, [("A", "tbd_1", "fine"), ("B", None, None)], 1),
        ("err", "Label: 404 Not Found\nOther: fine", "q", [], 1),
        ("near", "Label: a\nOther: b", notice, None, 1),
        ("q", "s", "Access denied", None, 1),
        ("page", "HTTP 403: Forbidden | cable\nMenu: a | b", None, None, 1),
        ("null", None, None, None, 1),
        (None, "404 not found", None, None, 1),
        ("ph", "Text with {desk} here", None, None, 1),
        ("long", "word " * 100_000 + "[object Object]", "", None, 1),
    ]
    df = spark.createDataFrame(rows, f"id string, state string, question string, options {OPTION}, kind int")
    assert {r["id"] for r in residue.residue(df).collect()} == {"ph", "opt", "err", "near", "q", "long", "page"}


SEGMENTS = "text_key binary, seg binary, kind string, trusted boolean, body string, n_words int"


def segments_of(spark, texts, trusted):
    return spark.createDataFrame([(t.encode(), t.encode(), "error_page" if t in trusted else None, t in trusted, t, len(t.split())) for t in texts], SEGMENTS)


def test_labels_spread_to_near_copies_only(spark):
    """A trusted text labels its near copies, hop by hop; a text sharing little stays."""
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join([*base[k:], *(f"x{i}" for i in range(k))]) for k in range(0, 20, 4)]
    far = " ".join([*base[:20], *(f"v{i}" for i in range(40))])
    reached = {bytes(r["seg"]).decode() for r in residue.spread(segments_of(spark, [*chain, far], {chain[0]})).collect()}
    assert residue.similarity(chain[0], chain[2]) < residue.SIMILARITY
    assert reached == set(chain)


def test_spread_against_brute_force(spark):
    """Texts of many lengths with words replaced, Jaccard down to 0.8; chains of them; texts just below."""
    rng = random.Random(5)
    texts, trusted = [], set()
    for size in (3, 5, 9, 20, 40, 80, 200):
        for _ in range(12):
            base = [f"w{rng.choice('abcdefgh')}{'x' * rng.randrange(9)}{rng.choice('ijklmnop')}{'y' * rng.randrange(9)}" for _ in range(size)]
            trusted.add(" ".join(base))
            for edits in (1, 1, 2, 2, 3, 4, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = f"z{rng.choice('abcdefgh')}{'x' * rng.randrange(99)}"
                texts.append(" ".join(copy))
            copy[0:1] = ["x", "y"]
            texts.append(" ".join(copy))  # near the last copy, perhaps not near the base
    expected, fresh = set(trusted), set(trusted)
    grams = {a: residue._grams(a) for a in expected.union(texts)}
    near = {a: {b for b, q in grams.items() if len(p & q) >= residue.SIMILARITY * len(p | q)} for a, p in grams.items()}
    while fresh:
        fresh = {b for a in fresh for b in near[a]} - expected
        expected |= fresh
    assert len(trusted) + 100 < len(expected) < len(near)
    reached = {bytes(r["seg"]).decode() for r in residue.spread(segments_of(spark, near, trusted)).collect()}
    assert reached <= expected and len(reached - trusted) >= 0.95 * len(expected - trusted)


def test_records_found_by_the_spread_alone(spark):
    """No rule sees the copies of a known text; their component does, hop by hop, codes aside. An ordinary text stays."""
    page = "dear visitor our archive rests tonight while technicians replace the old shelves so kindly return tomorrow after breakfast and bring your patience along with this number"
    copies = [f"{page} AB-12", page.replace("dear visitor", "dear guest"), page.replace("dear visitor", "dear guest").replace("this number", "that number 99")]
    assert all(JUDGE(x)[0] is None for x in (page, *copies))
    rows = [(f"c{i}", None, x if i else f"Note: {x}\nFrom: me", None) for i, x in enumerate(copies)] + [("ok", None, "the archive rests tonight while technicians replace the old shelves", None)]
    df = spark.createDataFrame(rows, f"id string, state string, question string, options {OPTION}")
    known = spark.createDataFrame([(page, "error_page"), (None, "filler")], "text string, kind string")
    assert {(r["id"], r["kind"]) for r in residue.residue(df, known).collect()} == {("c0", "error_page"), ("c1", "error_page"), ("c2", "error_page")}
    assert residue.residue(df).count() == 0


def test_hot_texts(spark):
    """A text that a third of all records share."""
    rows = [(f"i{k:04}", "404 Not Found" if k % 3 == 0 else f"An ordinary text {k} of its own", "What is it?", None) for k in range(1500)]
    df = spark.createDataFrame(rows, f"id string, state string, question string, options {OPTION}")
    assert {r["id"] for r in residue.residue(df).collect()} == {f"i{k:04}" for k in range(0, 1500, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], f"id string, state string, question string, options {OPTION}")
    assert residue.residue(df).count() == 0
