import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import leaks, packing, quality, ranks
from assayer.llm.canonical import words
from assayer.llm.text_stats import COLUMNS, measure, shape


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 5), st.integers(100, 180))
def test_best_fit_keeps_every_capacity(sizes, most, attention):
    sizes = np.array(sorted(sizes, reverse=True), int)
    bins = packing.best_fit(sizes, np.array([100.0, most, attention]), tile=10)
    for b in set(bins.tolist()):
        mine = sizes[bins == b]
        assert mine.sum() <= 100 and len(mine) <= most and (np.ceil(mine / 10) ** 2).sum() <= attention


@pytest.mark.parametrize(("sizes", "bound"), [([50] * 40, 0), ([1] * 300, 1), ([1930] + [5] * 20, 2)])
def test_each_capacity_binds(sizes, bound):
    """Two containers because of one capacity alone: without it, fewer."""
    whole = packing.capacities()
    n = lambda w: len(set(packing.best_fit(np.array(sizes), w).tolist()))
    if not bound:
        sizes = [400] * 6
    free = whole.copy()
    free[bound] = 1e9
    assert n(free) < n(whole)


def test_best_fit_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 900, 4000))[::-1]
    bins = packing.best_fit(sizes)
    assert len(set(bins.tolist())) <= 1.01 * -(-sizes.sum() // 2048)


def test_pack_covers_every_token_once(spark):
    rows = [(i, n) for i, n in enumerate([5, 2048, 2049, 4096, 0, 7000, 1, 2047] + [300] * 50)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), items_per_shard=10).collect()
    spans = {}
    for r in out:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == {d: n for d, n in rows if n}
    assert all(len(s) == 1 for d, s in spans.items() if rows[d][1] <= 2048)
    used = Counter()
    for r in out:
        used[r["container"]] += r["n_tokens"]
    assert max(used.values()) <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    hot = packing.pack(spark.createDataFrame([(7, 1000)] * 90, "doc_id long, n_tokens long"), items_per_shard=10).collect()
    assert len(hot) == 90 and len({r["container"].split("-")[0] for r in hot}) > 4
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), attention=9)


def test_token_counts(spark):
    rows = [(1, "Hello world, again.", 1), (2, "", 1), (3, None, 1), (None, "x", 1), (4, "a" * 100_000, 1), (5, "这份申请 <|endoftext|>", 1)]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()}
    assert got[1] == 5 and got[2] == 0 and set(got) == {1, 2, 4, 5}
    other = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(spark.createDataFrame([(1, "Hello world, again.")], "doc_id long, text string"), tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert other == {1: 5}


def test_counts_by_words_are_the_tokenizer_s():
    import json

    from tokenizers import Tokenizer

    body = open(packing.TOKENIZER, "rb").read()
    tokenizer = Tokenizer.from_str(body.decode())
    tokenizer.encode_special_tokens = True
    texts = ["Hello, WORLD's  end\n\ncan't\tI'LL 12345 — ok…", "", " \n", "这份申请 <|endoftext|> ΣΑΣ straße İx ǅ é é", "+---+\n|a | b|\x00", "x" * 5000, "🙂🙂 👩‍👩‍👧 ١٢٣ Ⅷ"]
    expected = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert packing.counter(body, "json")(texts) == expected
    assert packing._by_words(json.loads(body), lambda ts: [0] * len(ts)) is not None
    assert packing._by_words({"normalizer": None}, len) is None


def test_smith_waterman():
    def plain(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (leaks.MATCH if x == y else leaks.MISMATCH), row[j] + leaks.GAP, new[-1] + leaks.GAP))
            row = new
            best = max(best, *row)
        return best

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        assert leaks.smith_waterman(np.array(a), np.array(b))[0] == plain(a, b)


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    boiler = text(30)
    items = [(f"x{i}", text(40) if i % 3 else f"{boiler} {text(20)}") for i in range(12)] + [("short", "two words"), ("null", None), ("x1", None)]
    docs = []
    for d in range(150):
        _, t = items[rng.randrange(12)]
        w = t.split()
        n, k = rng.randrange(4, 30), rng.randrange(0, 20)
        passage = " ".join(w[k : k + n]).upper() if d % 2 else ">  ".join(w[k : k + n])
        docs.append((d, f"{text(30)}. {passage}!\n{text(10)}" if d % 5 else text(50)))
    docs += [(900, ""), (901, boiler), (902, text(30_000) + " " + items[1][1])]
    df = spark.createDataFrame([*((d, t, 1) for d, t in docs), (None, boiler, 1), (903, None, 1)], "doc_id long, text string, score int")
    exam = spark.createDataFrame([*items, items[0]], "id string, text string")
    found = leaks.leaks(df, exam)
    rows = found.collect()
    assert len(rows) == len({(r["doc_id"], r["item"]) for r in rows})
    expected = brute(docs, [x for x in items if x[1]], leaks.RUN)
    assert {(r["doc_id"], r["item"]) for r in rows if r["run"] >= leaks.RUN} == expected
    assert all(r["score"] >= leaks.MATCH * r["run"] for r in rows)
    assert leaks.leaks(df.limit(0), exam).count() == 0 and leaks.leaks(df, exam.limit(0)).count() == 0


def test_edited_copies_are_aligned(spark):
    """A word changed every 6 to 11 words: no stretch of 12 is whole, and elsewhere the item's rarest runs lie."""
    items = [(f"x{i}", " ".join(f"i{i}w{k}" for k in range(66))) for i in range(4)]
    docs = [(0, items[0][1])]
    for i, t in items:
        for every in range(6, 12):
            w = t.split()
            w[every - 1 :: every] = [f"e{every}w{k}" for k in range(len(w[every - 1 :: every]))]
            docs.append((len(docs), f"before it {' '.join(w)} and after it"))
            docs.append((len(docs), " ".join(w[:every])))
    docs.append((len(docs), " ".join(items[3][1].split()[60:] + items[3][1].split())))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = leaks.leaks(df, spark.createDataFrame(items, "id string, text string")).collect()
    assert {(r["doc_id"], r["item"]) for r in rows} == brute(docs, items, leaks.SEED_WORDS)
    assert all(r["score"] >= leaks.MATCH * r["run"] for r in rows)
    assert all(r["score"] >= 2 * 55 - 11 for r in rows if 0 < r["doc_id"] < 49 and r["doc_id"] % 2)


def test_recall_of_edited_copies(spark):
    """Copies with a word replaced, dropped or put in once every 6 to 12 words, beside phrases that every text holds."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    phrase = "as the rules of this desk say so often"
    items = [(f"x{i}", " ".join([phrase, *(rng.choice(vocabulary) for _ in range(rng.randrange(30, 90)))])) for i in range(12)]
    docs, copies = [(d, f"{phrase} {' '.join(rng.choice(vocabulary) for _ in range(60))}") for d in range(300)], set()
    for i, t in items:
        for every in range(6, 13):
            w = []
            for k, x in enumerate(t.split()):
                w += [x] if k % every or not k else [[], ["new"], [x, "more"]][rng.randrange(3)]
            copies.add((len(docs), i))
            docs.append((len(docs), f"It began so. {' '.join(w)}. It went on {phrase}"))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, text string")).where(f"score >= {leaks.MATCH * leaks.RUN}").collect()
    got = {(r["doc_id"], r["item"]) for r in found}
    assert len(got & copies) / len(copies) >= 0.99
    assert not got - copies  # the phrase alone, in every text, is no leak


def test_blocks_bound_what_is_broadcast(spark):
    exam = spark.createDataFrame([(f"x{i}", " ".join(f"w{i}x{k}" for k in range(20))) for i in range(10)], "id string, text string")
    assert [len(b) for b in leaks.blocks(exam, "id", "text", most=50)] == [2, 2, 2, 2, 2]


SENTENCES = "The desk closed the old case on Monday, because nobody had asked for it. We found nine more of them in the archive. "
SHAPES = {
    "prose": [SENTENCES * 3, "Yes.", "A short title", SENTENCES.upper(), SENTENCES.replace(" ", "\n", 4), "这份申请是否需要上报，由小组决定。根据条款，指标只能检查一次。", "Nach drei Wochen lehnte die Prüfung den Antrag ab, weil die Rechnung fehlte.", "Notes:\n" + SENTENCES * 2 + "\n- one entry\n- two entries", "“" + SENTENCES.replace(" ", "  ") + "”", ""],
    "list": ["1. open case\n2. closed case\n3. lost form\n4. new rule", "Open points\n\n* first desk;\n* second desk;\n* third form", "first desk\n\nsecond desk\n\nthird form\n\nfourth rule", "临时的桥梁:\n• 重复的摘要;\n• 公开的补贴;\n• 全新的窗口;"],
    "table": ["a\tb\tc\n1\t2\t3\n4\t5\t6", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "a,b,c\n1,2,3\n4,5,6\n7,8,9", '"a";"b"\n"1";"2"\n"3";"4"', "name          size          kind\nfirst         12            x\nsecond        9             yy", "+-----+-----+\n|a    |b    |\n|1    |2    |\n+-----+-----+"],
    "junk": ["home " * 30, "<div a=1></div><td b=2><li c=3></li>" * 5, "xq zkrt wvbn plkj hgfd sdfg qwrt zxcv bnmp lkjh gfds qwrtp " * 3, "$%#@{}~^ &*+=|<>" * 9, "7lrpVMvDmNc2hVe3pm7ngjBVdw5yOUBYsdAYv9efHZ4KFTeZQhFX4C0JIf4vsbWhdnl901JUn" * 3, "the of and to a in is was it for on with as by that this from at be or an are not which but had", "918 9 5418 1 9786885 71 4695339 14 486 18477 90393 18", "Ã¤rs inâ€™ ï¿½tsÂ ereâ€™ tirn Ã¤r ÃŸr" * 4],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_shapes(kind):
    for t in SHAPES[kind]:
        lang, s = measure(t)
        assert shape(s, lang, 99.0) == kind, (t[:60], s)
        assert (shape(s, lang) != "junk") or kind == "junk"


def test_measure():
    lang, s = measure("The cat, the dog.\nNo end")
    assert lang == "en" and s["n_words"] == 6 and s["line_end_ratio"] == 0.5 and s["mean_word"] == 2.83
    assert measure("这份申请")[0] == "zh" and measure("这份申请")[1]["n_words"] == 4
    assert set(measure("")[1]) == set(COLUMNS) and measure("\ud800x")[1]["n_words"] == 1
    assert measure("word. " * 100_000)[1]["n_words"] == 100_000


def test_languages():
    told = {
        "fr": "Le bureau a fermé le dossier dans la semaine, et il est dans les archives avec une note pour nous.", "es": "El despacho cerró el caso, pero los papeles están en una caja con la nota que se hizo para ellos.",
        "ru": "Дело закрыто в понедельник.", "ar": "أغلق المكتب القضية يوم الاثنين", "ja": "これはテストのぶんしょうです。", "ko": "사무실은 월요일에 사건을 종결했다.", "el": "Το γραφείο έκλεισε την υπόθεση.",
        "en": "The form o as os went to the desk.", "de": "Die Akte ist da.", "und": "Zukroo Jafru 12",
    }
    assert {k: measure(t)[0] for k, t in told.items()} == {k: k for k in told}


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de"]), float(rng.choice([0, 0, 0, rng.randrange(50)])), rng.random()) for _ in range(400)] + [("en", None, 0.5)]
    got = ranks.tails(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()
    assert {r["g"] for r in got} == {"en", "de", ranks.WHOLE}
    for r in got:
        col = [v["xy".index(r["stat"])] for g, *v in rows if r["g"] in (g, ranks.WHOLE)]
        col = [v for v in col if v is not None]
        assert r["low"] == pytest.approx((sum(v < r["value"] for v in col) + sum(v == r["value"] for v in col) / 2) / len(col)) and r["low"] + r["high"] == pytest.approx(1)


def test_quality(spark):
    """Every shape in a corpus that is mostly prose; ids may repeat or be null, other columns have clashing names."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(SENTENCES.split(". ")[:2]).replace("old", f"old{'er' * (i % 3)}") + "." for _ in range(1 + i % 9)) for i in range(150)]
    texts = [(i, t, 1) for i, t in enumerate(x for v in SHAPES.values() for x in v)] + [(500 + i, t, 1) for i, t in enumerate(prose)] + [(900, None, 1), (None, "No id.", 1), (500, prose[0], 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, stat int")
    got = {r["doc_id"]: r["shape"] for r in quality.shaped(df).collect()}
    kinds = [k for k, v in SHAPES.items() for _ in v]
    assert all(got[i] == k for i, k in enumerate(kinds)) and 900 not in got and got[500] == "prose"
    stats = quality.statistics(df)
    by = lambda d: {r["text_key"]: (r["outlier"], r["tail"]) for r in d.collect()}
    assert by(quality.scored(stats)) == by(quality.scored(stats, most_broadcast=0))
    assert quality.shaped(df.limit(0)).count() == 0
    # Without the scores some junk would be missed.
    alone = {r["doc_id"] for r in stats.where("certain").collect()}
    assert {i for i, k in enumerate(kinds) if k == "junk"} - alone


def test_copies_change_nothing(spark):
    """A text that is most of its language, or alone in it, keeps its shape, and so do those around it."""
    texts = [SHAPES["list"][3]] * 9 + ["这份申请是否需要上报，由小组决定。"] * 2 + ["x\ty\tz\n1\t2\t3\n4\t5\t6"] + [SENTENCES] * 5 + [SHAPES["list"][1]] * 20 + ["$%#@{}~^ &*+=|<>" * 9] * 90
    shapes = lambda ts: [r["shape"] for r in quality.shaped(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert shapes(texts) == ["list"] * 9 + ["prose"] * 2 + ["table"] + ["prose"] * 5 + ["list"] * 20 + ["junk"] * 90
    rng = random.Random(3)
    some = [f"{SENTENCES} {' '.join(rng.sample(SENTENCES.split(), 9))}" for _ in range(80)] + [x for v in SHAPES.values() for x in v]
    once = dict(zip(some, shapes(some), strict=True))
    many = some + [SHAPES["junk"][0]] * 200 + [SHAPES["junk"][5]] * 100
    assert shapes(many) == [once[t] for t in many]
