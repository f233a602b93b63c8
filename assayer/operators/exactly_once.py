"""Messages delivered more than once: exactly one copy of each identifier.

The frequency of every identifier is aggregated first (partial counts before the shuffle, so a hot
identifier costs a few rows), and those of repeated ones are written once to the shared folder, from
where both branches read them. Identifiers with one row pass directly and are never sorted. Only the
rows of repeated identifiers are ranked, by ``row_number() = 1``, which Spark also applies before
the shuffle (WindowGroupLimit): each map task sends one row per identifier on, however many copies
it holds. Both results are united.

Defined results: an empty table gives an empty table; rows with a null identifier cannot be told
apart and pass unchanged; rows equal in every ordering column tie and one of them, whichever, is
kept (they differ in nothing the order looks at; add a unique column to the order to fix it);
extra columns pass, also one called like a helper column, since helpers bear reserved names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans.lineage import written
from assayer.plans.skew import HEAVY_SHARE

_N = "__copies__"
_RANK = "__rank__"


def judged_first(correct: str = "correct", pos: str = "log_pos") -> list[Column]:
    """The last judged row wins; without any, the first unjudged one."""
    judged = F.col(correct).isNotNull()
    return [judged.desc(), F.when(judged, -F.col(pos)).otherwise(F.col(pos)).asc_nulls_last()]


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies): identifiers with two rows or more."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(_N)).where(F.col(_N) > 1)


@dataclass(frozen=True)
class Frequencies:
    """Repeated identifiers with their copies, written, and from how many copies on one is heavy."""

    repeated: DataFrame
    floor: int

    @property
    def heavy(self) -> DataFrame:
        """A share of HEAVY_SHARE of the repeated rows or more: at most 1 / HEAVY_SHARE identifiers."""
        return self.repeated.where(F.col(_N) >= self.floor).drop(_N)

    @property
    def light(self) -> DataFrame:
        return self.repeated.where(F.col(_N) < self.floor).drop(_N)


def frequencies(rows: DataFrame, key: str) -> Frequencies:
    counts = written(repeated_keys(rows, key), "repeated-keys")
    total = counts.agg(F.sum(_N)).first()[0] or 0
    return Frequencies(counts, max(2, int(total * HEAVY_SHARE)))


def best_of_repeated(rows: DataFrame, key: str, order: Sequence[Column], counts: Frequencies | None = None) -> DataFrame:
    """One row for each identifier that has two or more: the first in ``order``.

    Rows of heavy identifiers are picked out by a broadcast of those few and never shuffled whole.
    """
    counts = counts or frequencies(rows, key)
    heavy = F.broadcast(counts.heavy)
    mine = rows.join(heavy, key, "left_semi").unionByName(rows.join(heavy, key, "left_anti").join(counts.light, key, "left_semi"))
    ranked = mine.withColumn(_RANK, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


def singletons(rows: DataFrame, key: str, counts: Frequencies | None = None) -> DataFrame:
    """Rows whose identifier occurs once, and those without an identifier."""
    counts = counts or frequencies(rows, key)
    return rows.join(F.broadcast(counts.heavy), key, "left_anti").join(counts.light, key, "left_anti")


def exactly_once(stored: DataFrame, key: str, order: Sequence[Column], arrived: DataFrame | None = None) -> DataFrame:
    """One row per identifier over all stored and newly arrived messages."""
    rows = stored if arrived is None else stored.unionByName(arrived)
    counts = frequencies(rows, key)
    return singletons(rows, key, counts).unionByName(best_of_repeated(rows, key, order, counts).select(*rows.columns))
