"""Splits that keep related records together.

A family is (source, group_id), both trimmed and in lower case; a record without a group stands
for itself, by id. Families that share a record id belong together too, and so on: components are
found by hash-to-min over the families that share an id with another one, which are few; all other
families are components of their own and take no part in the rounds.

A component goes to the split that wins weighted rendezvous hashing: the greatest of
ln(u) / weight, where u is a hash of seed, split and component between 0 and 1. That depends on
nothing but the component, the seed and the weights: large components are treated like small ones,
families that come later move no one, and a greater weight only takes from the other splits. Since
one component may be a third of all rows, some seeds reach the proportions better than others, and
weights that allow for what large components bring do better than the proportions themselves.
``fit`` tries SEEDS seeds over all components at once, corrects the weights of each ROUNDS - 1
times by what they fell short, and names the nearest ``Plan``. A deployment fits it once and keeps
it: with a plan given, ``assign`` looks at no sizes.

Defined results: rows without an id or a source still get a split (their family is built from what
is there, '' for a missing part); rows of the same id and family count as often as delivered; an
empty table gives no rows; proportions need not sum to one; splits of proportion 0 or null get none;
equal scores go to the first split by name; plans that come equally near go by round and number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import hash_to_min
from assayer.plans.lineage import written
from assayer.plans.skew import join_by_counted_key

SEED = "assayer"
#: Seeds that ``fit`` tries, and how often it corrects the weights of each.
SEEDS, ROUNDS = 32, 4
PRIME = 2**31 - 1


def clean(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def family(source: str = "source", group_id: str = "group_id", id_: str = "id") -> Column:
    """One text per family; a record without a group is a family by its id."""
    of_group = F.concat_ws("\x1f", F.lit("g"), clean(source), clean(group_id))
    return F.when(F.col(group_id).isNotNull(), of_group).otherwise(F.concat_ws("\x1f", F.lit("i"), clean(source), F.coalesce(F.col(id_), F.lit(""))))


def sized_components(records: DataFrame) -> DataFrame:
    """(family, source, group_id, component, n_rows, first_split, last_split, n_splits) of records(id, source, group_id, split); written.

    source and group_id are as in the family; the splits are those that its rows were delivered in.
    """
    named = records.select("id", family().alias("family"), F.when(F.col("source").isNotNull(), clean("source")).alias("source"), F.when(F.col("group_id").isNotNull(), clean("group_id")).alias("group_id"), "split")
    per = written(named.groupBy("family", "id", "source", "group_id", "split").agg(F.count(F.lit(1)).alias("n")), "split-family-ids")
    held = per.where(F.col("id").isNotNull()).select("family", "id").distinct()
    shared = held.groupBy("id").agg(F.min("family").alias("first"), F.count(F.lit(1)).alias("families")).where(F.col("families") > 1)
    shared = written(shared, "split-shared-ids")
    total = shared.agg(F.sum("families")).first()[0]
    if total:  # an id may stand in very many families
        edges = join_by_counted_key(held, shared, "id", "families", total).select(F.col("family").alias("a"), F.col("first").alias("b")).where(F.col("a") != F.col("b")).distinct()
        linked = hash_to_min(edges)
    else:
        linked = shared.select(F.lit("").alias("node"), F.lit("").alias("component")).limit(0)
    sizes = per.groupBy("family").agg(
        F.min("source").alias("source"), F.min("group_id").alias("group_id"), F.sum("n").alias("n_rows"), F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count_distinct("split").alias("n_splits")
    )
    found = sizes.join(linked.withColumnRenamed("node", "family"), "family", "left")
    return written(found.withColumn("component", F.coalesce("component", "family")), "split-components")


def spot(component: Column, split: str, seed: str = SEED) -> Column:
    """A whole number below PRIME from SHA-256; the same in any engine."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(split), component), 256), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def uniform(at: Column, number: Column) -> Column:
    """The number inside (0, 1) that seed ``number`` gives a spot: multiply and add, modulo PRIME."""
    return (F.pmod(at * F.pmod(number * number * 7919 + number * 15485863 + 1299709, F.lit(PRIME)) + number * 32452843, F.lit(PRIME)).cast("double") + F.lit(0.5)) / F.lit(float(PRIME))


def rendezvous(spots: dict[str, Column], weights: dict[str, Column], number: Column) -> Column:
    """The split with the greatest weighted score."""
    scores = [F.struct((F.log(uniform(at, number)) / weights[s]).alias("score"), F.lit(-i).alias("tie"), F.lit(s).alias("split")) for i, (s, at) in enumerate(spots.items())]
    if not scores:
        return F.lit(None).cast("string")
    return F.greatest(*scores)["split"] if len(scores) > 1 else scores[0]["split"]


@dataclass(frozen=True)
class Plan:
    """What decides a component's split besides its name; to be kept, so that later families move none."""

    number: int
    weights: dict[str, float]
    seed: str = SEED

    def split_of(self, component: Column) -> Column:
        spots = {s: spot(component, s, self.seed) for s in self.weights}
        return rendezvous(spots, {s: F.lit(w) for s, w in self.weights.items()}, F.lit(self.number).cast("bigint"))


def fit(parts: DataFrame, targets: dict[str, float], seeds: int = SEEDS, rounds: int = ROUNDS, seed: str = SEED) -> Plan:
    """The seed and weights under which the rows of all components come nearest to the proportions."""
    shares = {s: w for s, w in sorted(targets.items()) if w and w > 0}
    whole = math.fsum(shares.values())
    names = list(shares)
    at = parts.select("n_rows", *[spot(F.col("component"), s, seed).alias(f"at{i}") for i, s in enumerate(names)])
    tried = at.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(seeds - 1).cast("bigint"))).alias("number"))
    weights = [dict(shares) for _ in range(seeds)]
    best = (math.inf, 0, 0, dict(shares))
    for turn in range(rounds if names else 0):
        each = {s: F.element_at(F.array(*[F.lit(w[s]) for w in weights]), (F.col("number") + 1).cast("int")) for s in names}
        split = rendezvous({s: F.col(f"at{i}") for i, s in enumerate(names)}, each, F.col("number"))
        sums = {(r["number"], r["split"]): r["n"] for r in tried.groupBy("number", split.alias("split")).agg(F.sum("n_rows").alias("n")).collect()}  # seeds x splits
        total = sum(n for (k, _), n in sums.items() if k == 0)
        for k in range(seeds):
            got = {s: sums.get((k, s), 0) for s in names}
            best = min(best, (round(sum(abs(got[s] - total * shares[s] / whole) for s in names), 6), turn, k, dict(weights[k])), key=lambda x: x[:3])
            for s in names:
                weights[k][s] *= min(4.0, max(0.25, total * shares[s] / whole / max(1, got[s])))
    return Plan(best[2], best[3], seed)


def assign(records: DataFrame, targets: dict[str, float], plan: Plan | None = None) -> DataFrame:
    """``sized_components`` with the new split of every family; the plan is fitted where none is given."""
    parts = sized_components(records)
    plan = fit(parts, targets) if plan is None else plan
    return parts.withColumn("new_split", plan.split_of(F.col("component")))


def with_new_split(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """records with ``component`` and ``new_split``; rows of a family that is a large part of all lie where they are."""
    total = assigned.agg(F.sum("n_rows")).first()[0] or 0
    keyed = assigned.select(F.col("family").alias("__family__"), F.col("n_rows").alias("__rows__"), "component", "new_split")
    joined = join_by_counted_key(records.withColumn("__family__", family()), keyed, "__family__", "__rows__", total)
    return joined.drop("__family__", "__rows__")


def torn(assigned: DataFrame) -> DataFrame:
    """(source, group_id, component, new_split, n_splits): families that were delivered in two splits or more, and the one they get."""
    rows = assigned.where(F.col("group_id").isNotNull() & F.col("source").isNotNull() & (F.col("first_split") != F.col("last_split")))
    return rows.select("source", "group_id", "component", "new_split", "n_splits")
