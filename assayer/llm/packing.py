"""Filling containers of a fixed number of tokens with documents.

Only a document longer than a container is split: into full containers and one remainder. What is
then to be packed (id, piece, tokens) is narrow; it is spread over shards of about
ITEMS_PER_SHARD items, whose number follows the input, and every shard is packed by vector
best-fit: items go, largest first, into the open container that is left closest to full, measured
as the weighted norm of what remains of its three capacities - tokens, documents and attention cost -
among those where all three suffice. A shard leaves at most a few containers part-filled, which is
what sharding costs (far under one per cent).

The attention cost of a document is the square of its tiles of TILE tokens, as kernels that keep
documents apart compute whole tiles. A container has room for a document of full length and
TILES more, so many short documents beside a long one, or very many short ones, meet that
bound before the tokens are used up; MOST_DOCUMENTS bounds how many share a container.

The tokenizer's file is read where the query is called and sent to the tasks, if it is no larger
than MOST_BYTES (its proven bound); executors need no copy of it. Text enters in whole.

Defined results: null ids and null texts are left out, as are texts without a token; an id given
twice is packed twice; equal sizes go by id; a text of exactly the capacity is not split; an empty
table gives no containers; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans.lineage import written

CAPACITY = 2048
MOST_DOCUMENTS = 64
TILE, TILES = 128, 16
ITEMS_PER_SHARD = 20_000
#: What tokens, documents and attention cost count for in the norm of what remains.
WEIGHTS = (1.0, 0.01, 0.01)
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
MOST_BYTES = 64 * 1024 * 1024
# Fixed value: how the public byte-level vocabularies split text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(body: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """What counts the tokens of texts, from a tokenizer's file (``json`` or ``tiktoken``)."""
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, body.splitlines())}
        encode = tiktoken.Encoding("assayer", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(body.decode())
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    whole = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _by_words(json.loads(body), whole) or whole


#: Words whose number of tokens a task remembers before it begins anew.
MOST_REMEMBERED = 400_000


def _by_words(told: dict, whole: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]] | None:
    """The same counts from those of the words, each looked up once, if the tokenizer cuts lower-case text into words that it treats one by one; else None."""
    import regex

    normal = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or not cuts[0].get("invert") or cuts[0].get("behavior") != "Removed" or cuts[1].get("use_regex") or cuts[1].get("add_prefix_space") or "Regex" not in cuts[0]["pattern"] or told["normalizer"]["normalizers"][1].get("pattern") != {"Regex": r"\s+"}:
        return None
    words, known = regex.compile(cuts[0]["pattern"]["Regex"]).findall, {}

    def of(texts: list[str]) -> list[int]:
        if len(known) > MOST_REMEMBERED:
            known.clear()
        cut = [words(unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()) for t in texts]  # no final form, as signs are lowered one by one
        if fresh := list({w for ws in cut for w in ws} - known.keys()):
            known.update(zip(fresh, whole(fresh), strict=True))
        return [sum(map(known.__getitem__, ws)) for ws in cut]

    return of


def token_counts(documents: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text."""
    with open(tokenizer, "rb") as file:
        body = file.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise ValueError(f"a tokenizer of more than {MOST_BYTES} bytes: {tokenizer}")
    shipped, kind_ = documents.sparkSession.sparkContext.broadcast(body), tokenizer.rpartition(".")[2]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(shipped.value, kind_)
        for pdf in batches:
            texts = [t.encode("utf-8", "replace").decode() for t in pdf["text"]]  # lone surrogates are no text
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": count(texts)})

    rows = documents.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(of, f"doc_id {kind}, n_tokens long")


def needs(tokens: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Per item what it takes of each capacity: tokens, documents, attention cost."""
    tiles = -(-tokens.astype(np.int64) // tile)
    return np.stack([tokens, np.ones(len(tokens)), tiles * tiles], axis=1).astype(float)


def capacities(capacity: int = CAPACITY, most_documents: int = MOST_DOCUMENTS, attention: float | None = None, tile: int = TILE) -> np.ndarray:
    whole = -(-capacity // tile)
    return np.array([capacity, most_documents, whole * whole + TILES if attention is None else attention], float)


def best_fit(tokens: np.ndarray, whole: np.ndarray | None = None, weights: tuple[float, float, float] = WEIGHTS, tile: int = TILE) -> np.ndarray:
    """The container of each item; items must fit one by one. tokens should fall."""
    whole = capacities() if whole is None else whole
    out = np.empty(len(tokens), np.int64)
    need = needs(tokens, tile)
    scale = np.sqrt(np.array(weights)) / whole
    room = np.empty((1024, 3))
    names = np.empty(1024, np.int64)
    n = made = 0
    least = need.min(axis=0) if len(tokens) else whole
    for k in range(len(tokens)):
        left = room[:n] - need[k]
        at = np.flatnonzero((left >= 0).all(axis=1))
        if len(at):
            best = at[np.argmin(((left[at] * scale) ** 2).sum(axis=1))]
        else:
            if n == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            room[n], names[n], best = whole, made, n
            n, made = n + 1, made + 1
        room[best] -= need[k]
        out[k] = names[best]
        if (room[best] < least).any():  # nothing fits any more: close it
            n -= 1
            room[best], names[best] = room[n], names[n]
    return out


def pack(counts: DataFrame, capacity: int = CAPACITY, items_per_shard: int = ITEMS_PER_SHARD, most_documents: int = MOST_DOCUMENTS, attention: float | None = None, tile: int = TILE) -> DataFrame:
    """(container, doc_id, piece, start, n_tokens): every token of every document in one container."""
    whole = capacities(capacity, most_documents, attention, tile)
    if (needs(np.array([capacity]), tile)[0] > whole).any():
        raise ValueError("a piece of full length must fit a container")
    # Where a row lies is written with it, so that rows of one id spread over shards, and do so again in a retry.
    counts = written(counts.where(F.col("n_tokens") > 0).withColumn("spread", F.monotonically_increasing_id()), "packing-counts")
    cap = F.lit(capacity)
    last = F.floor((F.col("n_tokens") - 1) / cap).cast("long")
    pieces = counts.select("doc_id", "n_tokens", "spread", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "spread", "piece", (F.col("piece") * cap).alias("start"), F.least(cap.cast("long"), F.col("n_tokens") - F.col("piece") * cap).alias("n_tokens"))
    full = pieces.where(F.col("n_tokens") == cap).select(F.concat_ws("-", F.lit("f"), F.col("spread").cast("string"), F.col("piece").cast("string")).alias("container"), "doc_id", "piece", "start", "n_tokens")
    shards = max(1, -(-counts.count() // items_per_shard))
    rest = pieces.where(F.col("n_tokens") < cap).withColumn("shard", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards)).cast("int")).drop("spread")
    kind = counts.schema["doc_id"].dataType.simpleString()

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(pdf["n_tokens"].to_numpy(), whole, tile=tile)
        shard = pdf["shard"].iloc[0]
        return pd.DataFrame({"container": [f"s{shard}-{b}" for b in bins], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["n_tokens"]})

    packed = rest.groupBy("shard").applyInPandas(of, f"container string, doc_id {kind}, piece long, start long, n_tokens long")
    return full.unionByName(packed)
