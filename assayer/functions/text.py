"""Text as columns: normal form, hashes, letters, JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWX"
_WORD = r"([\p{L}\p{N}_]+)"


def normalized(text: str | Column) -> Column:
    """Lower case, words of letters, digits and _ joined by one space; all JVM-side.

    Equal to the exact form for text that is NFKC-stable and whose only special case folding is the
    German sharp s; ``normalized_exact`` holds for all of Unicode.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(_WORD), F.lit(1)), " ")


def normalized_exact(text: str | Column) -> Column:
    """NFKC, full case folding, words joined by one space, in Arrow batches."""
    import re

    word = re.compile(r"\w+")

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else " ".join(word.findall(unicodedata.normalize("NFKC", t).casefold())) for t in texts], dtype=object)

    return of(F.col(text) if isinstance(text, str) else text)


def content_hash(text: str | Column, exact: bool = False) -> Column:
    return F.sha2(normalized_exact(text) if exact else normalized(text), 256)


def number_of(*parts: Column | str, digits: int = 12) -> Column:
    """A whole number from the first hex digits of SHA-256 of the parts joined by ':'; the same in any engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")


def letter(index: Column) -> Column:
    """The letter of a place that counts from one."""
    return F.substring(F.lit(LETTERS), index, F.lit(1)) if not isinstance(index, int) else F.lit(LETTERS[index - 1])


def count_of_signs(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def percent(value: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%"))


def object_hashes(text: str | Column) -> Column:
    """(plain, ascii): SHA-256 of the normal form of a JSON object's text with sorted names, without and with escapes beyond ASCII; null for other texts."""
    import hashlib
    import json
    import re

    word = re.compile(r"\w+")

    def of_text(t: str | None) -> dict | None:
        try:
            value = json.loads(t) if t else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, dict):
            return None
        forms = (json.dumps(value, sort_keys=True, ensure_ascii=a) for a in (False, True))
        plain, ascii_ = (hashlib.sha256(" ".join(word.findall(unicodedata.normalize("NFKC", f).casefold())).encode("utf-8", "surrogatepass")).hexdigest() for f in forms)
        return {"plain": plain, "ascii": ascii_}

    @F.pandas_udf("struct<plain:string,ascii:string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of_text(t) or {"plain": None, "ascii": None} for t in texts], columns=["plain", "ascii"])

    both = of(F.col(text) if isinstance(text, str) else text)
    return F.when(both["plain"].isNotNull(), both)
