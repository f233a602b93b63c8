"""Evaluation texts inside a corpus: n-gram seeds and local alignment.

1. All five-word runs of the test items are counted over the whole corpus (documents that hold them).
2. A run in few documents (RARE_SHARE of all, or RARE_DOCUMENTS) is a rare seed: one of them is
   enough to join document and item. Runs in more documents are phrases that many texts use; by
   those alone a pair is joined if its common runs cover RUN of the item's words, which is counted
   exactly, so that neither a copy of boilerplate nor an edited copy made of common phrases is lost.
3. Documents are read once more; where seeds join a passage and an item, common runs are extended
   word by word and merged, and Smith-Waterman alignment of the item with the passage around its
   seeds scores edited and paraphrased copies. A pair is a leak by its score: at least that of RUN
   words in a row, which every text with such a run reaches.

The items' runs reach the tasks in blocks of at most BLOCK_RUNS (16 bytes each), which is the bound
on what is broadcast; a larger test set takes several passes over the corpus. Documents are never
shuffled. Defined results: null ids and texts are left out; items under five words have no seed
and are never found; an item that is in the table twice is one item; words are compared ignoring
case and everything that is neither letter nor digit; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.canonical import words as words_of
from assayer.llm.residue import mix
from assayer.llm.tokens import WordHash, flat

SEED_WORDS, RUN = 5, 12
RARE_SHARE, RARE_DOCUMENTS = 0.001, 20
BLOCK_RUNS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(words: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    """The hash of the run that begins at each word; shorter than words by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix(h * _ODD + words[i : i + n] + np.uint64(i + 1))
    return h


def blocks(items: DataFrame, id_: str, text: str, most: int = BLOCK_RUNS) -> Iterator[dict[str, np.ndarray]]:
    """{item: hashed words}, in blocks of at most ``most`` runs (or one item)."""
    memory, block, size = WordHash(), {}, 0
    rows = items.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct()
    for r in rows.orderBy("id", "text").toLocalIterator():
        w = flat([words_of(r["text"])], memory)[0]
        if len(w) < SEED_WORDS:
            continue
        if block and size + len(w) > most:
            yield block
            block, size = {}, 0
        name = r["id"] if r["id"] not in block else f"{r['id']}\x1f{len(block)}"
        block[name], size = w, size + len(w)
    if block:
        yield block


def _hits(h: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h of wanted runs, their numbers)."""
    at = np.searchsorted(wanted, h)
    at[at == len(wanted)] = 0
    found = np.flatnonzero(wanted[at] == h)
    return found, at[found]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, where texts begin, run hashes over all words of the batch)."""
    memory = WordHash()
    for pdf in batches:
        words, starts = flat((words_of(t) for t in pdf["text"]), memory)
        yield pdf["doc_id"], words, starts, runs(words)


def frequencies(documents: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each of the wanted runs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), np.int64)
        for _, _, starts, h in _batches(batches):
            at, which = _hits(h, wanted)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + SEED_WORDS <= starts[doc + 1]
            once = np.unique(np.stack([doc[inside], which[inside]]), axis=1)
            total += np.bincount(once[1], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"run": some, "n": total[some]})

    out = np.zeros(len(wanted), np.int64)
    for r in documents.mapInPandas(of, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toLocalIterator():  # at most the block's runs
        out[r["run"]] = r["n"]
    return out


def rare(counts: np.ndarray, documents: int) -> np.ndarray:
    """Which runs are rare: in at most RARE_SHARE of the documents, or in RARE_DOCUMENTS."""
    return (counts > 0) & (counts <= max(RARE_DOCUMENTS, int(documents * RARE_SHARE)))


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best local score, matched words of a at most) of two word arrays; gaps cost as much as mismatches."""
    if not len(a) or not len(b):
        return 0, 0
    steps = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best = 0
    for x in a:
        cand = np.zeros(len(b) + 1, np.int64)
        cand[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(cand, 0, out=cand)
        row = np.maximum.accumulate(cand + steps) - steps
        best = max(best, int(row.max()))
    return best, min(len(a), best // MATCH + (best % MATCH > 0))


def common_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """(begin in a, length) of the common run of a and b through a[i] == b[j]."""
    back = 0
    while i - back > 0 and j - back > 0 and a[i - back - 1] == b[j - back - 1]:
        back += 1
    on = 0
    while i + on < len(a) and j + on < len(b) and a[i + on] == b[j + on]:
        on += 1
    return i - back, back + on


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "id", item_text: str = "text", block_runs: int = BLOCK_RUNS) -> DataFrame:
    """(doc_id, item, run, shared, score, item_words) of each pair that is scored.

    run is the longest common run of words, shared the item's words inside common runs of five or
    more, score that of the best local alignment.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item string, run int, shared int, score int, item_words int"
    out, total = rows.sparkSession.createDataFrame([], schema), None
    for block in blocks(items, item_id, item_text, block_runs):
        total = rows.count() if total is None else total
        wanted = np.unique(np.concatenate([runs(w) for w in block.values()]))
        counts = frequencies(rows, wanted)
        if counts.any():
            out = out.unionByName(rows.mapInPandas(_aligner(block, wanted[counts > 0], rare(counts, total)[counts > 0]), schema))
    item = F.element_at(F.split("item", "\x1f"), 1)
    return out.withColumn("item", item).groupBy("doc_id", "item").agg(*[F.max(c).alias(c) for c in ("run", "shared", "score", "item_words")])


def _chains(hits: list[tuple[int, int]], text: np.ndarray, item: np.ndarray) -> tuple[int, int, list[int]]:
    """(longest common run, item words in common runs, where the item would begin) of seed hits (place in text, place in item)."""
    longest, known, covered = 0, {}, np.zeros(len(item), bool)
    for i, j in hits:
        if i < known.get(i - j, -1):
            continue  # inside a run that is known
        begin, n = common_run(text, i, item, j)
        known[i - j] = begin + n
        longest = max(longest, n)
        covered[begin - i + j : begin - i + j + n] = True
    return longest, int(covered.sum()), sorted(known)


def _aligner(items: dict[str, np.ndarray], wanted: np.ndarray, is_rare: np.ndarray) -> object:
    # Flat arrays: as many seeds as a block has runs may reach a task.
    names, words_of_items = list(items), list(items.values())
    h = [runs(w) for w in words_of_items]
    flat_h, which, place = np.concatenate(h), np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h])
    at = np.searchsorted(wanted, flat_h)
    at[at == len(wanted)] = 0
    here = np.flatnonzero(wanted[at] == flat_h)
    here = here[np.argsort(at[here], kind="stable")]
    first = np.searchsorted(at[here], np.arange(len(wanted) + 1))
    which, place = which[here].astype(np.int32), place[here].astype(np.int32)
    del h, flat_h, at, here

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, words, starts, h in _batches(batches):
            at, seed = _hits(h, wanted)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + SEED_WORDS <= starts[doc + 1]
            pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            seeded: set[tuple[int, int]] = set()
            for p, d, x in zip(at[inside].tolist(), doc[inside].tolist(), seed[inside].tolist(), strict=True):
                lo, hi = first[x], first[x + 1]
                for k, j in zip(which[lo:hi].tolist(), place[lo:hi].tolist(), strict=True):
                    pairs[d, k].append((p - int(starts[d]), j))
                    if is_rare[x]:
                        seeded.add((d, k))
            out = []
            for (d, k), hits in pairs.items():
                text, item = words[starts[d] : starts[d + 1]], words_of_items[k]
                longest, shared, begins = _chains(hits, text, item)
                if (d, k) not in seeded and shared < RUN:
                    continue  # nothing but a common phrase
                score, half, done = 0, len(item) // 2, None
                for b in begins:
                    if done is not None and b <= done:
                        continue  # lies whole inside the last window
                    lo, hi = max(0, b - half), max(0, min(len(text), b + len(item) + half))
                    score, done = max(score, smith_waterman(item, text[lo:hi])[0]), b + half
                out.append((ids.iloc[d], names[k], longest, shared, score, len(item)))
            yield pd.DataFrame(out, columns=["doc_id", "item", "run", "shared", "score", "item_words"])

    return of
