"""Template residue and error-page text: trusted labels spread over near-duplicate segments.

1. Every distinct text of the records (state, question, option description, option key) is cut into
   segments: the values of a JSON object, the values of ``Label: value`` lines and their whole, else
   the whole text.
2. Rules label segments that hold residue; one that consists of it by TRUST or more is trusted: a copy
   that lacks the residue is not near it any more. Texts known to be residue (a table, if given)
   are trusted as well, whatever the rules say of them.
3. Segments are near if the Jaccard similarity of their five-word shingles is 0.8 or more; words with
   a digit (codes, references, times) are left out before. Near ones of the trusted are looked for
   in partitioned SimHash tables: a SimHash of BITS bits is cut into TABLES blocks of 16, and
   segments meet that agree in a block and are alike in length. Those within HAMMING bits are then
   compared word by word. At a similarity of 0.8 about an eighth to a sixth of the bits differ, hence
   so many tables and so wide a radius; the tests measure a recall of 0.9 and more.
   A segment can only be near a trusted one if four fifths of its own shingles stand in trusted ones,
   which a bit map of fixed size answers (with false alarms, never the other way); so SimHashes are
   made of those segments alone.
4. Labels spread from trusted segments along verified pairs, hop by hop, until nothing new is
   reached: these are exactly the connected components that hold a trusted segment. Segments with a
   little residue amid real content are labelled themselves but label no others, since a near copy
   of such a text may lack the residue.
5. A record is residue if any of its segments is.

Only labelled segments are paired with unlabelled ones, so no bucket of either kind is squared.
Defined results: nulls, empty texts and null options hold no residue; a null id is left out;
repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.canonical import _BREAK, _LINE, WORD
from assayer.llm.residue_rules import Judge, key_is_residue
from assayer.llm.tokens import WordHash, flat
from assayer.plans.lineage import written
from assayer.plans.skew import join_in_parts

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a SimHash, its blocks of 16 bits (one table each), and in how many bits near ones may differ.
BITS, TABLES, HAMMING = 1536, 96, 390
#: Bits of the map of shingles that stand in trusted segments: 8 MB, whatever their number.
MAP_BITS = 1 << 26
#: Fewer shingles than this cannot be near without being equal.
LEAST_SHINGLES = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)


def segments(text: str) -> list[str]:
    body = text.strip()
    if body[:1] == "{":
        try:
            return [x for x in _leaves(json.loads(body, strict=False)) if x.strip()]
        except (ValueError, RecursionError):
            return [body]
    if ":" in body:
        lines = [x for x in _BREAK.split(body) if x.strip()]
        if len(lines) > 1:
            fields = [_LINE.fullmatch(x) for x in lines]
            if all(fields):
                # An error page may look like such lines, its message standing where a label would.
                return [*(m[2] for m in fields if m[2].strip()), body]
    return [body] if body else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, wrapping."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each text's begin; a shorter text is one run."""
    lengths = np.diff(starts)
    n = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    begin = np.repeat(starts[:-1] - at[:-1], n) + np.arange(at[-1])
    long = np.repeat(np.minimum(lengths, size), n)
    h = np.zeros(len(begin), np.uint64)
    for i in range(size):
        inside = i < long
        h[inside] = mix(h[inside] * _ODD + words[begin[inside] + i] + np.uint64(i + 1))
    return h, at


_LANES = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(BITS // 64)]


def distinct_shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each once per text."""
    h, at = shingles(words, starts)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=len(at) - 1))))


def simhash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHashes (a row of bytes per text) of shingle hashes, text i's being h[at[i]:at[i + 1]]."""
    n = np.diff(at)
    out = np.zeros((len(n), BITS // 8), np.uint8)
    step, i = 1 << 14, 0
    while i < len(n):  # so many shingles at a time, or one text
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        mine = h[at[i] : at[j]]
        some = i + np.flatnonzero(n[i:j])
        if len(some):
            for k, lane in enumerate(_LANES):
                bits = np.unpackbits(mix(mine * lane + lane).view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, at[some] - at[i], axis=0, dtype=np.int32)
                out[some, 8 * k : 8 * k + 8] = np.packbits(ones * 2 > n[some][:, None], axis=1)
        i = j
    return out


def record_texts(records: DataFrame) -> DataFrame:
    """(id, text, is_key): each text of each record."""
    options = F.coalesce("options", F.expr("cast(array() as array<struct<label:string,key:string,description:string>>)"))
    texts = F.concat(
        F.array(F.struct(F.col("state").alias("text"), F.lit(False).alias("is_key")), F.struct(F.col("question").alias("text"), F.lit(False).alias("is_key"))),
        F.transform(options, lambda o: F.struct(o["description"].alias("text"), F.lit(False).alias("is_key"))),
        F.transform(options, lambda o: F.struct(o["key"].alias("text"), F.lit(True).alias("is_key"))),
    )
    rows = records.where(F.col("id").isNotNull()).select("id", F.explode(texts).alias("t"))
    return rows.select("id", "t.text", "t.is_key").where(F.col("text").isNotNull())


_DIGIT = re.compile(r"\d").search


def _text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def judged_segments(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(text_key, n_rows, seg, n_words, kind, trusted, body) of the segments of distinct (text, is_key, n_rows); written.

    ``known`` (text, kind) adds texts that are residue as a whole; they belong to no record.

    ``body`` are the segment's words but for those with a digit, ``seg`` is their hash.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge()
        for pdf in batches:
            rows = []
            for key, text, is_key, n in zip(pdf["text_key"], pdf["text"], pdf["is_key"], pdf["n_rows"], strict=True):
                if is_key:
                    w = WORD.findall(text.casefold())
                    rows.append((key, "placeholder" if key_is_residue(text) else None, False, " ".join(x for x in w if not _DIGIT(x)), len(w), n))
                    continue
                for s in segments(text):
                    w = WORD.findall(s.casefold())
                    kind, trusted = judge(s, w)
                    rows.append((key, kind, trusted, " ".join(x for x in w if not _DIGIT(x)), len(w), n))
            if rows:
                yield pd.DataFrame(rows, columns=["text_key", "kind", "trusted", "body", "n_words", "n_rows"])

    schema = "text_key binary, kind string, trusted boolean, body string, n_words int, n_rows long"
    found = texts.select(_text_key().alias("text_key"), "text", "is_key", "n_rows").mapInPandas(of, schema)
    if known is not None:

        def as_known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                bodies = [WORD.findall(t.casefold()) for t in pdf["text"]]
                yield pd.DataFrame({"text_key": None, "kind": pdf["kind"], "trusted": True, "body": [" ".join(x for x in w if not _DIGIT(x)) for w in bodies], "n_words": [len(w) for w in bodies], "n_rows": 0})

        whole = known.where(F.col("text").isNotNull()).select("text", F.coalesce("kind", F.lit("known")).alias("kind"))
        found = found.unionByName(whole.mapInPandas(as_known, schema))
    return written(found.withColumn("seg", F.unhex(F.md5("body"))), "residue-segments")


def distinct_segments(segs: DataFrame) -> DataFrame:
    """(seg, kind, trusted, body): each segment that holds words, once; written."""
    once = segs.where(F.col("body") != "").groupBy("seg").agg(F.min("kind").alias("kind"), F.max("trusted").alias("trusted"), F.min("body").alias("body"))
    return written(once, "residue-distinct")


def shingle_map(bodies: DataFrame) -> np.ndarray:
    """The bit map of all shingles of the bodies; its size is fixed."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHash()
        for pdf in batches:
            h, _ = shingles(*flat((b.split(" ") for b in pdf["body"]), memory))
            at = np.unique(h & np.uint64(MAP_BITS - 1)).astype(np.int64)
            yield pd.DataFrame({"place": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    out = np.zeros(MAP_BITS >> 6, np.uint64)
    found = bodies.select("body").mapInPandas(of, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most MAP_BITS / 64 rows
    out[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def sketched(rows: DataFrame, known: object | None = None) -> DataFrame:
    """(seg, n, sketch, blocks) of rows (seg, body), with ``known`` only of those that can be near a text of that map."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = WordHash()
        for pdf in batches:
            h, at = distinct_shingles(*flat((b.split(" ") for b in pdf["body"]), memory))
            n = np.diff(at)
            keep = n >= LEAST_SHINGLES
            if known is not None and len(h):
                place = h & np.uint64(MAP_BITS - 1)
                held = np.concatenate(([0], np.cumsum(known.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)))).astype(np.int64)
                keep &= (held[at[1:]] - held[at[:-1]]) * 5 >= n * 4
            at_, mine = np.concatenate(([0], np.cumsum(n[keep]))), h[np.repeat(keep, n)]
            s = simhash(mine, at_)
            blocks = s.view(np.uint16).astype(np.int32) + (np.arange(TABLES, dtype=np.int32) << 16)
            if len(s):
                yield pd.DataFrame({"seg": list(pdf["seg"][keep]), "n": n[keep], "sketch": list(s.view(np.int64)), "blocks": list(blocks)})

    return rows.select("seg", "body").mapInPandas(of, "seg binary, n int, sketch array<long>, blocks array<int>")


def _grams(text: str) -> set:
    w = text.split(" ")
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def similarity(x: str, y: str) -> float:
    """Jaccard on five-word shingles."""
    if x == y:
        return 1.0
    p, q = _grams(x), _grams(y)
    return len(p & q) / len(p | q)


def jaccard_column(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(xs, ys, strict=True)])

    return of(a, b)


def _band(n: str) -> Column:
    """Lengths of near segments are of one band or of two that lie side by side."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(1 / SIMILARITY) + 1e-9).cast("int")


def near(frontier: DataFrame, rest: DataFrame) -> DataFrame:
    """(seg, kind) of the segments of rest (seg, body) that are near one of the frontier's (seg, kind, body)."""
    spark = rest.sparkSession
    known = spark.sparkContext.broadcast(shingle_map(frontier))  # 8 MB
    ours = written(sketched(frontier), "residue-probes").join(frontier.select("seg", "kind"), "seg")
    probe = ours.select(F.col("seg").alias("from_seg"), F.col("n").alias("from_n"), "kind", F.col("sketch").alias("from_sketch"), F.explode("blocks").alias("block"))
    probe = probe.withColumn("band", F.explode(F.array(*[_band("from_n") + k for k in (-1, 0, 1)])))
    theirs = written(sketched(rest, known), "residue-sketches")
    tables = theirs.select("seg", "n", "sketch", F.explode("blocks").alias("block")).withColumn("band", _band("n"))
    differ = F.aggregate(F.zip_with("sketch", "from_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    pairs = tables.join(probe, ["block", "band"]).where(differ <= HAMMING).select("seg", "from_seg", "kind").distinct()
    texts, from_texts = rest.select("seg", "body"), frontier.select(F.col("seg").alias("from_seg"), F.col("body").alias("from_body"))
    both = pairs.join(texts.join(theirs.select("seg"), "seg", "left_semi"), "seg").join(from_texts, "from_seg")
    return both.where(jaccard_column("body", "from_body") >= SIMILARITY).groupBy("seg").agg(F.min("kind").alias("kind"))


def spread(segs: DataFrame) -> DataFrame:
    """(seg, kind) of all segments in a component with a trusted one, itself included."""
    distinct = distinct_segments(segs)
    frontier = distinct.where("trusted").select("seg", "kind", "body")
    reached = written(frontier.select("seg", "kind"), "residue-trusted")
    while not frontier.isEmpty():
        found = written(near(frontier, distinct.join(reached, "seg", "left_anti")), "residue-hop")
        reached = reached.unionByName(found)
        frontier = distinct.select("seg", "body").join(found, "seg").select("seg", "kind", "body")
    return written(reached, "residue-reached")


def labelled_texts(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(text_key, kind, n_rows): the distinct texts that hold residue, and in how many rows they stand."""
    texts = record_texts(records).groupBy("text", "is_key").agg(F.count(F.lit(1)).alias("n_rows"))
    segs = judged_segments(texts, known)
    own = segs.where(F.col("kind").isNotNull()).select("text_key", "kind", "n_rows")
    via = segs.where(F.col("kind").isNull() & (F.col("body") != "")).join(spread(segs).withColumnRenamed("kind", "via"), "seg").select("text_key", F.col("via").alias("kind"), "n_rows")
    return written(own.unionByName(via).where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.min("kind").alias("kind"), F.max("n_rows").alias("n_rows")), "residue-texts")


def residue(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, kind): records with residue and, of its kinds, the first by name; ``known`` (text, kind) are texts that label their near copies.

    The rows of a text that very many records share are dealt to many tasks by the records' ids.
    """
    labels = labelled_texts(records, known)
    total = labels.agg(F.sum("n_rows")).first()[0] or 0
    held = record_texts(records).select("id", _text_key().alias("text_key"))
    return join_in_parts(held, labels, "text_key", "n_rows", "id", total).groupBy("id").agg(F.min("kind").alias("kind"))
