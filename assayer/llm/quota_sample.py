"""A sample that matches target proportions per cell (source x number of options).

1. Quotas: the wanted table is fractional (sample size x per mille). Controlled rounding makes it
   whole: every cell becomes its floor or its ceiling, and so do every row sum, every column sum and
   the total, which a largest flow through rows -> cells -> columns finds. A second flow, with the
   minimums below and what is there above each cell, makes up for missing ids in other cells as far
   as both margins allow. What then remains open stays open, rather than bend a margin.
2. Draw: each record id has a key from SHA-256 of seed and id. A cell takes the ids with its
   smallest keys, exactly as many as its quota. A histogram of key prefixes per cell, which is
   aggregated before it is shuffled, says in which prefix the last one lies; all ids before it are
   taken as they are and only those inside that one prefix are ranked, so a cell with a third of
   all rows is never sorted.

Defined results: an id counts once per cell however often it was delivered; an id in several cells
belongs to each; rows without id or options, or in no cell of the targets, are never drawn; a cell
with fewer ids than it needs gives all it has and is reported as short; one drawn below its rounded quota shows
it in ``change``; targets need not sum to 1,000; cells
given twice count with their sum and larger minimum; ties of keys break by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.max_flow import Network
from assayer.plans.lineage import written

SEED = "assayer-sample-1"
PREFIX_DIGITS = 3  # 4,096 prefixes per cell


def controlled_rounding(table: dict[tuple[str, int], tuple[int, int]]) -> dict[tuple[str, int], int]:
    """Whole quotas of a table of fractions (numerator, common denominator 1 part each).

    Each cell, row sum, column sum and the total end at the floor or the ceiling of what they were.
    """
    rows = sorted({r for r, _ in table})
    cols = sorted({c for _, c in table})
    floor = {k: n // d for k, (n, d) in table.items()}
    from fractions import Fraction

    exact = {k: Fraction(n, d) for k, (n, d) in table.items()}
    row = {r: sum((exact[k] for k in table if k[0] == r), Fraction(0)) for r in rows}
    col = {c: sum((exact[k] for k in table if k[1] == c), Fraction(0)) for c in cols}
    row_base = {r: sum(floor[k] for k in table if k[0] == r) for r in rows}
    col_base = {c: sum(floor[k] for k in table if k[1] == c) for c in cols}
    source, sink = 0, 1 + len(rows) + len(cols)
    net = Network(sink + 3)
    outer, inner = sink + 1, sink + 2
    # Lower bounds by the usual way: what must flow is pushed first, through outer -> ... -> inner.
    must = 0

    def bounded(a: int, b: int, low: int, high: int) -> None:
        nonlocal must
        if high > low:
            net.add(a, b, high - low)
        if low:
            net.add(outer, b, low)
            net.add(a, inner, low)
            must += low

    up = lambda x: -(-x.numerator // x.denominator)
    for i, r in enumerate(rows):
        bounded(source, 1 + i, row[r].__floor__() - row_base[r], up(row[r]) - row_base[r])
    for j, c in enumerate(cols):
        bounded(1 + len(rows) + j, sink, col[c].__floor__() - col_base[c], up(col[c]) - col_base[c])
    edge = {k: net.add(1 + rows.index(k[0]), 1 + len(rows) + cols.index(k[1]), 1) for k in sorted(table) if exact[k] != floor[k]}
    total, base = sum(exact.values(), Fraction(0)), sum(floor.values())
    bounded(sink, source, total.__floor__() - base, up(total) - base)
    if net.push(outer, inner) != must:
        raise ArithmeticError("no controlled rounding found")  # cannot happen: one always exists
    return {k: floor[k] + (net.flow_of(edge[k]) if k in edge else 0) for k in table}


def cells(records: DataFrame) -> DataFrame:
    """(source, n_options, id), once each."""
    rows = records.where(F.col("id").isNotNull() & F.col("options").isNotNull() & F.col("source").isNotNull())
    return rows.select(F.lower(F.trim("source")).alias("source"), F.size("options").cast("bigint").alias("n_options"), "id").distinct()


def read_targets(targets: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """{cell: (per mille, minimum)}; a small table by nature, one row per cell."""
    out: dict[tuple[str, int], tuple[int, int]] = {}
    for r in targets.collect():
        k = (r["source"].strip().lower(), int(r["n_options"]))
        ppt, least = out.get(k, (0, 0))
        out[k] = (ppt + (r["target_ppt"] or 0), max(least, r["min_rows"] or 0))
    return out


def sample_size(records: DataFrame, part: int = 5) -> int:
    return records.select("id").where(F.col("id").isNotNull()).distinct().count() // part


def flow_quotas(targets: dict[tuple[str, int], tuple[int, int]], available: dict[tuple[str, int], int], size: int) -> dict[tuple[str, int], tuple[int, int, int]]:
    """{cell: (rounded, needed, quota)}: what the proportions say, the least that meets the target, and what is drawn.

    A largest flow through rows -> cells -> columns. Every cell carries at least what it needs, as far
    as that is there, and at most what is there; every row and column at most its rounded margin (or,
    where minimums lift it, what its cells need). First cells are filled up to their rounded quota;
    then what missing ids left open in a row and in a column is made up by other cells, so long as
    both margins hold, moving quotas along alternating paths where no single cell would do.
    """
    if not targets:
        return {}
    rounded = controlled_rounding({k: (size * ppt, 1000) for k, (ppt, _) in targets.items()})
    need = {k: max(least, size * ppt // 1000) for k, (ppt, least) in targets.items()}
    low = {k: min(need[k], available.get(k, 0)) for k in targets}
    rows, cols = sorted({r for r, _ in targets}), sorted({c for _, c in targets})
    margin = lambda of: max(sum(rounded[k] for k in of), sum(low[k] for k in of)) - sum(low[k] for k in of)
    net = Network(2 + len(rows) + len(cols))
    for i, r in enumerate(rows):
        net.add(0, 2 + i, margin([k for k in targets if k[0] == r]))
    for j, c in enumerate(cols):
        net.add(2 + len(rows) + j, 1, margin([k for k in targets if k[1] == c]))
    there = {k: available.get(k, 0) for k in targets}
    first = {k: max(0, min(rounded[k], there[k]) - low[k]) for k in targets}
    edge = {k: net.add(2 + rows.index(k[0]), 2 + len(rows) + cols.index(k[1]), first[k]) for k in sorted(targets)}
    net.push(0, 1)
    for k, e in edge.items():
        net.edges[e][1] += there[k] - low[k] - first[k]
    net.push(0, 1)
    return {k: (rounded[k], need[k], low[k] + net.flow_of(edge[k])) for k in targets}


def quota_table(spark: SparkSession, targets: dict[tuple[str, int], tuple[int, int]], have: DataFrame, size: int) -> DataFrame:
    """(source, n_options, available, rounded, needed, quota, short, change): one row per cell of the targets.

    ``short``: the flow could not give the cell what it needs. ``change``: ids drawn beyond (or, negative, below) the rounded quota.
    """
    cells_ = spark.createDataFrame([*targets] or [], "source string, n_options bigint")
    counts = have.join(F.broadcast(cells_), ["source", "n_options"]).groupBy("source", "n_options").agg(F.count(F.lit(1)).alias("available"))
    available = {(r["source"], r["n_options"]): r["available"] for r in counts.collect()}  # at most one row per cell of the targets
    rows = [(*k, available.get(k, 0), rounded, need, quota, quota < need, quota - rounded) for k, (rounded, need, quota) in sorted(flow_quotas(targets, available, size).items())]
    return spark.createDataFrame(rows, "source string, n_options bigint, available bigint, rounded bigint, needed bigint, quota bigint, short boolean, change bigint")


def draw(have: DataFrame, quotas: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, n_options, id) of the sample."""
    cell = ["source", "n_options"]
    limits = F.broadcast(quotas.select(*cell, "quota"))  # one row per cell of the targets
    keyed = have.join(limits, cell).withColumn("key", F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256)).withColumn("prefix", F.substring("key", 1, PREFIX_DIGITS))
    counts = keyed.groupBy(*cell, "prefix", "quota").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
    cut = cut.select(*cell, F.col("prefix").alias("last"), (F.col("quota") - (F.col("upto") - F.col("n"))).alias("rest"))
    marked = keyed.join(F.broadcast(cut), cell)  # at most one row per cell
    before = marked.where(F.col("prefix") < F.col("last"))
    inside = marked.where(F.col("prefix") == F.col("last")).withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "id")))
    return before.select(*cell, "id").unionByName(inside.where(F.col("rank") <= F.col("rest")).select(*cell, "id"))


def sample(records: DataFrame, targets: DataFrame, part: int = 5, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(the drawn ids by cell, the quota report)."""
    have = written(cells(records), "sample-cells")
    quotas = written(quota_table(records.sparkSession, read_targets(targets), have, sample_size(records, part)), "sample-quotas")
    return draw(have, quotas, seed), quotas


def unmet(quotas: DataFrame, columns: Sequence[str] = ("source", "n_options")) -> DataFrame:
    return quotas.where("short").select(*columns)
