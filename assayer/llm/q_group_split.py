"""Queries on splits that keep families together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm import group_split as G
from assayer.sources.tables import table


def _targets(spark: SparkSession, sf: str) -> dict[str, float]:
    return {r["split"]: r["proportion"] for r in table(spark, sf, "split_targets").collect()}  # one row per split


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records").select("id", "source", "group_id", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return G.torn(G.assign(_records(spark, sf), _targets(spark, sf))).select("source", "group_id")


def p5_assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered record with its new split."""
    rows = _records(spark, sf)
    return G.with_new_split(rows, G.assign(rows, _targets(spark, sf))).select("id", "source", "group_id", "component", "new_split")


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and families per new split, the share reached and the share wanted."""
    targets = _targets(spark, sf)
    assigned = G.assign(_records(spark, sf), targets)
    per = assigned.groupBy("new_split").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("families"))
    whole = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # over one row per split
    wanted = F.create_map(*[x for k, v in sorted(targets.items()) for x in (F.lit(k), F.lit(v))])
    return per.select("new_split", "n_rows", "families", F.round(F.col("n_rows") / whole, 6).alias("share"), wanted[F.col("new_split")].alias("wanted"))


QUERIES = {"p5_found": p5_found, "p5_assigned": p5_assigned, "p5_shares": p5_shares}

# The same by other means: components by following the smallest family to the end, seeds one after another.
_ASSIGNED = f"""
r AS (SELECT id, source, group_id, CASE WHEN group_id IS NOT NULL THEN concat_ws(chr(31), 'g', lower(trim(coalesce(source, ''))), lower(trim(group_id)))
         ELSE concat_ws(chr(31), 'i', lower(trim(coalesce(source, ''))), coalesce(id, '')) END AS family FROM records),
held AS (SELECT DISTINCT id, family FROM r WHERE id IS NOT NULL),
edge AS (SELECT DISTINCT a.family AS a, b.family AS b FROM held a JOIN held b ON a.id = b.id AND a.family <> b.family),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT f.family, least(f.family, coalesce(min(reach.b), f.family)) AS component, any_value(f.n) AS n
         FROM (SELECT family, count(*) AS n FROM r GROUP BY family) f LEFT JOIN reach ON reach.a = f.family GROUP BY f.family),
spot AS (SELECT c.component, t.split, t.proportion, CAST('0x' || substr(sha256(concat_ws(':', '{G.SEED}', t.split, c.component)), 1, 8) AS BIGINT) % {G.PRIME} AS spot
         FROM (SELECT DISTINCT component FROM comp) c CROSS JOIN split_targets t WHERE t.proportion > 0)"""
_SHARE = "(SELECT sum(n) FROM comp) * t.proportion / (SELECT sum(proportion) FROM split_targets WHERE proportion > 0)"


def _round_sql(k: int) -> str:
    """Round k: the splits won under each seed's weights, what they sum to, how far off that is."""
    weight = "t.proportion" if not k else f"v.weight * least(4.0::DOUBLE, greatest(0.25::DOUBLE, {_SHARE} / greatest(1, v.n)))"
    source = f"range({G.SEEDS}) q(number) CROSS JOIN split_targets t WHERE t.proportion > 0" if not k else f"sum{k - 1} v JOIN split_targets t ON t.split = v.split"
    number = "q.number" if not k else "v.number"
    return f""",
weight{k} AS (SELECT {number} AS number, t.split, {weight} AS weight FROM {source}),
won{k} AS (SELECT s.component, w.number, arg_max(s.split, ln(((s.spot * ((w.number * w.number * 7919 + w.number * 15485863 + 1299709) % {G.PRIME}) + w.number * 32452843) % {G.PRIME} + 0.5::DOUBLE) / {float(G.PRIME)}::DOUBLE) / w.weight) AS split
         FROM spot s JOIN weight{k} w ON w.split = s.split GROUP BY ALL),
sum{k} AS (SELECT w.number, w.split, any_value(w.weight) AS weight, coalesce(sum(c.n), 0) AS n FROM weight{k} w LEFT JOIN won{k} x ON x.number = w.number AND x.split = w.split LEFT JOIN comp c ON c.component = x.component GROUP BY w.number, w.split),
off{k} AS (SELECT v.number, {k} AS turn, round(sum(abs(v.n - {_SHARE})), 6) AS off FROM sum{k} v JOIN split_targets t ON t.split = v.split GROUP BY v.number)"""


_ASSIGNED += "".join(_round_sql(k) for k in range(G.ROUNDS)) + f""",
best AS (SELECT number, turn FROM ({" UNION ALL ".join(f"SELECT * FROM off{k}" for k in range(G.ROUNDS))}) ORDER BY off, turn, number LIMIT 1),
won AS ({" UNION ALL ".join(f"SELECT component, split, number, {k} AS turn FROM won{k}" for k in range(G.ROUNDS))}),
assigned AS (SELECT c.family, c.component, c.n, w.split AS new_split FROM comp c JOIN won w USING (component) JOIN best USING (number, turn))"""

SQL = {
    "p5_found": """
SELECT lower(trim(source)) AS source, lower(trim(group_id)) AS group_id
FROM records WHERE group_id IS NOT NULL AND source IS NOT NULL AND split IS NOT NULL
GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
    "p5_assigned": f"WITH RECURSIVE {_ASSIGNED} SELECT r.id, r.source, r.group_id, a.component, a.new_split FROM r JOIN assigned a USING (family)",
    "p5_shares": f"WITH RECURSIVE {_ASSIGNED} SELECT a.new_split, CAST(sum(a.n) AS BIGINT) AS n_rows, count(*) AS families, round(sum(a.n) / (SELECT count(*) FROM r), 6) AS share, any_value(t.proportion) AS wanted FROM assigned a JOIN split_targets t ON t.split = a.new_split GROUP BY a.new_split",
}
