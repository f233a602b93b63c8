"""Per-document text statistics, outlier scores from exact ranks, and the shape of each text.

``statistics`` reads every text once. ``scored`` ranks each statistic exactly within its language
and among all texts (see ``ranks``) and combines the empirical tail
probabilities: the sum of -ln of the tail that speaks for junk, over the statistics. ``shaped``
decides: structure tells tables, lists and prose; a text with a sign of junk that is beyond doubt
is junk; one with a possible sign is junk if its outlier score says that it stands out among the
texts of its language or among all.

Ranks are over distinct texts, equal values in the middle of their places, so that copies change
neither their own score nor others': a text fetched a million times is one text.

Defined results: a null text has no statistics and no row; an empty text or one without words has
the statistics 0, no language and, unless it holds symbols, the shape prose; a null or repeated id
is a row like any other; a text that is alone in its language has middling ranks there and is
told by those among all; a text that is alone is junk by a certain sign only; the stored language and length are not trusted
and not used; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.ranks import WHOLE, long_form, tails
from assayer.llm.text_stats import COLUMNS, DIRECTIONS, OUTLIER, measure, signs, structure
from assayer.plans.lineage import written
from assayer.plans.skew import join_by_counted_key

#: Rows of the rank table up to which it is broadcast (about 50 bytes each).
MOST_BROADCAST = 400_000
_UNKNOWN = "und"


def statistics(documents: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, language, COLUMNS, structure, possible, certain) of every text; written."""
    rows = documents.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("text_key", F.unhex(F.md5("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[bytes, tuple] = {}
            out = []
            for d, k, t in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], strict=True):
                if k not in known:
                    lang, s = measure(t)
                    known[k] = (k, lang, *(float(s[c]) for c in COLUMNS), structure(s), *signs(s, lang))
                out.append((d, *known[k]))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "language", *COLUMNS, "structure", "possible", "certain"])

    schema = f"doc_id {kind}, text_key binary, language string, {', '.join(f'{c} double' for c in COLUMNS)}, structure string, possible boolean, certain boolean"
    return written(rows.mapInPandas(of, schema), "quality-stats")


def _tail(stat: Column) -> Column:
    """The tail probability that speaks for junk, of a rank row."""
    out = F.lit(None).cast("double")
    for name, sign in DIRECTIONS.items():
        out = F.when(stat == name, F.col("high") if sign > 0 else F.col("low") if sign < 0 else 2 * F.least("low", "high")).otherwise(out)
    return out


def scored(stats: DataFrame, wanted: DataFrame | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(text_key, outlier, tail) of the distinct texts of ``wanted``, all by default: the score and the smallest tail probability.

    The greater score of two: within the language, and among all texts (a language may hold little but junk).
    """
    texts = written(stats.select("text_key", "language", *DIRECTIONS).dropDuplicates(["text_key"]), "quality-texts")
    ranks = written(tails(texts, "language", [*DIRECTIONS]), "quality-ranks")
    mine = texts if wanted is None else texts.join(wanted.select("text_key").distinct(), "text_key", "left_semi")
    groups = F.explode(F.array_except(F.array("language", F.lit(WHOLE)), F.array(F.lit(_UNKNOWN)))).alias("language")
    numbered = long_form(mine.select("text_key", groups, *DIRECTIONS), ["text_key", "language"], [*DIRECTIONS])
    key = ["language", "stat", "value"]
    if ranks.count() <= most_broadcast:  # ratios have at most 10,001 values per language, lengths as many as there are
        found = numbered.join(F.broadcast(ranks), key)
    else:  # some values, as a ratio of 0, are those of most texts
        name = F.concat_ws("\x1f", "language", "stat", F.col("value").cast("string"))
        total = 2 * ranks.where(F.col("language") == WHOLE).agg(F.sum("n")).first()[0]
        found = join_by_counted_key(numbered.withColumn("rank_key", name), ranks.withColumn("rank_key", name).drop(*key), "rank_key", "n", total)
    tail = found.select("text_key", "language", _tail(F.col("stat")).alias("tail"))
    per = tail.groupBy("text_key", "language").agg(F.round(F.sum(-F.log("tail")), 6).alias("outlier"), F.round(F.min("tail"), 9).alias("tail"))
    return per.groupBy("text_key").agg(F.max("outlier").alias("outlier"), F.min("tail").alias("tail"))


def shaped(documents: DataFrame) -> DataFrame:
    """(doc_id, shape) of every text; only texts with a possible, uncertain sign are scored."""
    stats = statistics(documents)
    open_ = F.col("possible") & ~F.col("certain")
    junk = scored(stats, stats.where(open_)).where(F.col("outlier") >= OUTLIER).select("text_key", F.lit(True).alias("stands_out"))
    decided = stats.where(~open_).select("doc_id", F.when(F.col("certain"), "junk").otherwise(F.col("structure")).alias("shape"))
    copies = stats.where(open_).select("doc_id", "text_key", "structure")
    return decided.unionByName(_with(copies, junk).select("doc_id", F.when(F.col("stands_out"), "junk").otherwise(F.col("structure")).alias("shape")))


def _with(rows: DataFrame, keyed: DataFrame, ways: int = 16) -> DataFrame:
    """rows left-joined with what is known of their text; copies of one text are spread over ``ways`` tasks."""
    spread = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(ways)).cast("int")).join(spread, ["text_key", "salt"], "left").drop("salt")


def outliers(documents: DataFrame) -> DataFrame:
    """(doc_id, language, structure, possible, certain, outlier, tail) of every text."""
    stats = statistics(documents)
    return _with(stats.select("doc_id", "text_key", "language", "structure", "possible", "certain"), scored(stats)).drop("text_key")
