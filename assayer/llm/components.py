"""Connected components by hash-to-min, as relations.

Every node holds a cluster, first itself and its neighbours. In a round each node sends its whole
cluster to the smallest member it knows and that smallest member to all others; what a node gets
is its next cluster. In the end the smallest node of a component holds all of it and every other
node holds only that smallest one, which takes about as many rounds as the logarithm of the
longest path. Clusters are rows (node, member), never arrays, so no cluster has to fit into a task;
each round is written to the shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans.lineage import written
from assayer.plans.skew import join_by_counted_key


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component, for every node of an edge.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("member")).where(F.col("node").isNotNull() & F.col("member").isNotNull())
    both = pairs.unionByName(pairs.select(F.col("member").alias("node"), F.col("node").alias("member")))
    own = both.select("node", F.col("node").alias("member"))
    clusters = written(both.unionByName(own).distinct(), "components-0")
    size = (clusters.count(), None)
    for k in range(1, most_rounds + 1):
        least = written(clusters.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("held")), f"components-least-{k}")
        known = join_by_counted_key(clusters, least, "node", "held", size[0])  # a hub may hold a large part of all rows
        sent = known.select(F.col("least").alias("node"), "member").unionByName(known.select(F.col("member").alias("node"), F.col("least").alias("member")))
        fresh = written(sent.distinct(), f"components-{k}")
        now = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        clusters = fresh
        if tuple(now) == size:
            break
        size = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return clusters.groupBy("node").agg(F.min("member").alias("component"))
