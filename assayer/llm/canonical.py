"""Canonical words of a state: what is left when formatting and field order are taken away.

A word is an unbroken run of letters and digits, case ignored. Running text gives its words in
order. A JSON object gives, for each field in sorted order, the words of the name and of the value,
at any depth; arrays keep their order. Lines ``Label: value``, if all lines are such, are fields too.

Defined results: null stays null; a text without a word (also the empty one) gives ''; text that
begins like JSON but is none is running text; a label line list of one line is running text.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"\s*([^:]+?)\s*:(.*)", re.S)
_BREAK = re.compile(r"[\r\n]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def _of_json(value: object) -> list[str]:
    if isinstance(value, str):
        return words(value)
    if isinstance(value, dict):
        return [w for name, inner in sorted((words(k), _of_json(v)) for k, v in value.items()) for w in (*name, *inner)]
    if isinstance(value, list):
        return [w for v in value for w in _of_json(v)]
    return ["null"] if value is None else [str(value).casefold()] if isinstance(value, bool) else words(str(value))


def _pairs_as_lists(pairs: list) -> dict:
    """Repeated names keep all their values, in order, as an array does."""
    out: dict = {}
    for k, v in pairs:
        out[k] = [*out[k], v] if k in out and isinstance(out[k], list) else [out[k], v] if k in out else v
    return out


def canonical_words(text: str) -> list[str]:
    body = text.strip()
    if body[:1] in ("{", "["):
        try:
            return _of_json(json.loads(body, parse_float=str, parse_int=str, strict=False, object_pairs_hook=_pairs_as_lists))
        except (ValueError, RecursionError):
            return words(text)
    if ":" in body:
        lines = [x for x in _BREAK.split(body) if x.strip()]
        if len(lines) > 1:
            fields = [_LINE.fullmatch(x) for x in lines]
            if all(fields):
                return [w for name, value in sorted((words(m[1]), words(m[2])) for m in fields) for w in (*name, *value)]
    return words(text)


def canonical(text: str | None) -> str | None:
    return None if text is None else " ".join(canonical_words(text))


def canonical_column(column: str | Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        known = {t: canonical(t) for t in texts.unique()}  # equal texts of a batch once
        return texts.map(known).astype(object).where(texts.notna(), None)

    return of(F.col(column) if isinstance(column, str) else column)


def key_column(canonical: str | Column) -> Column:
    """128 bits of SHA-256 of the canonical words; equal for equal words, else different."""
    return F.unhex(F.substring(F.sha2(canonical, 256), 1, 32))
