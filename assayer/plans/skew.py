"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on; so there are at most 1 / HEAVY_SHARE heavy keys,
#: which is the proven bound under which they are broadcast.
HEAVY_SHARE = 1 / 2000


def join_by_counted_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key, where ``count`` says how many rows a key has.

    Heavy keys (a share of HEAVY_SHARE or more: at most 2,000 of them, whatever the data) are
    broadcast and their rows joined where they lie; the rest is shuffled, with no key above that
    share left. Neither side may hold a null key.
    """
    floor = max(1, int(total * HEAVY_SHARE))
    heavy = keyed.where(F.col(count) >= floor)
    light = keyed.where(F.col(count) < floor)
    marks = F.broadcast(heavy.select(key))
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(marks, key, "left_anti").join(light, key))


def join_in_parts(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: str, total: int) -> DataFrame:
    """Inner join of rows, read once, with one row per key, where ``count`` says how many rows a key has, at least about.

    The rows of a heavy key (a share of HEAVY_SHARE or more: at most 2,000 keys, which are broadcast)
    are dealt into parts of about that share by a hash of ``spread``; its one row is repeated for each part.
    """
    floor = max(1, int(total * HEAVY_SHARE))
    ways = F.ceil(F.col(count) / floor).cast("int")
    parts = F.broadcast(keyed.where(F.col(count) > floor).select(key, ways.alias("__ways")))
    dealt = rows.join(parts, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__ways")).cast("int"), F.lit(0))).drop("__ways")
    repeated = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1)))
    return dealt.join(repeated, [key, "__part"]).drop("__part")


def expand(links: DataFrame, members: DataFrame, key: str, least: int = 5_000) -> DataFrame:
    """Inner join of links with the members of their keys, where either may repeat a key and one key may hold most members.

    A key with a share of HEAVY_SHARE of all members or more (at most 2,000 keys, which are broadcast)
    is cut into parts of about that share by a hash of the member, and its links are repeated for each part.
    """
    total = members.count()
    floor = max(least, int(total * HEAVY_SHARE))
    heavy = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor)
    parts = F.broadcast(heavy.select(key, F.ceil(F.col("__n") / floor).cast("int").alias("__parts")))
    rest = [c for c in members.columns if c != key]
    cut = members.join(parts, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    told = links.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return told.join(cut, [key, "__part"]).drop("__part")


def salted(column: str | Column, ways: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ways))
