"""Sinks: JSON lines, lists, tables for reading, and checks that what was written is what was meant."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SinkError(RuntimeError):
    pass


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Compact JSON lines with null fields kept; refuses to overwrite unless told."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_sorted_set(rows: DataFrame, column: str, path: str) -> None:
    """Distinct values in order, over as many files as the data needs (range-partitioned, sorted inside)."""
    rows.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value").write.mode("errorifexists").text(path)


def write_pairs(rows: DataFrame, a: str, b: str, path: str) -> None:
    pairs = rows.select(a, b).distinct().orderBy(a, b)
    pairs.select(F.concat_ws("\t", a, b).alias("value")).write.mode("errorifexists").text(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_manifest(document: dict, path: str) -> None:
    """Whole or not at all: a temporary file beside it, synced, then renamed."""
    target = Path(path)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, target)


def archived(path: str) -> str:
    """Renames a file or folder out of the way to the first free numbered name; gives that name."""
    p, k = Path(path), 1
    while (to := p.with_name(f"{p.name}.{k}")).exists():
        k += 1
    p.rename(to)
    return str(to)


def verify_written(rows: DataFrame, back: DataFrame) -> None:
    """Raises unless what is read back equals what was written, as multisets."""
    a, b = rows, back.select(*rows.columns)
    comparable = [c for c, t in rows.dtypes if not t.startswith("map")]
    a, b = a.select(*comparable), b.select(*comparable)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise SinkError("what was read back differs from what was written")


def markdown(rows: DataFrame, columns: Sequence[str] | None = None, most: int = 200) -> str:
    """A report table; of more than ``most`` rows the first ones, and a line that says so."""
    columns = list(columns or rows.columns)
    kinds = {f.name: f.dataType for f in rows.schema}
    show = lambda c, v: "–" if v is None else f"{v:.4f}" if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    found = rows.select(*columns).limit(most + 1).collect()
    for r in found[:most]:
        lines.append("| " + " | ".join(show(c, r[c]) for c in columns) + " |")
    if len(found) > most:
        lines.append("| " + " | ".join(["… more rows than shown", *[""] * (len(columns) - 1)]) + " |")
    return "\n".join(lines) + "\n"


def nested(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> dict:
    """A long report as nested dictionaries: {key1: {key2: {value: ...}}}; reports are small."""
    out: dict = {}
    for r in rows.collect():
        at = out
        for k in keys:
            at = at.setdefault(str(r[k]), {})
        at |= {v: r[v] for v in values}
    return out
