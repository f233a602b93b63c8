"""An answer log that keeps growing: resume, identity, compaction, running accuracy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.dedup import compacted

BUCKETS = 16


class IdentityError(RuntimeError):
    pass


def unfinished(inputs: DataFrame, log: DataFrame, key: str = "id", judged: str = "correct") -> DataFrame:
    """Inputs without a judged answer yet: new ones and those whose every attempt failed."""
    return inputs.join(log.where(F.col(judged).isNotNull()).select(key).distinct(), key, "left_anti")


def identity_problems(log: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(field, n_bad): rows whose identity is null or another than this run's."""
    return log.agg(*[F.count_if(~F.equal_null(F.col(k), F.lit(v))).alias(k) for k, v in expected.items()]).select(
        F.explode(F.create_map(*[x for k in expected for x in (F.lit(k), F.col(k))])).alias("field", "n_bad")
    )


def check_identity(log: DataFrame, expected: dict[str, str]) -> None:
    if bad := identity_problems(log, expected).where("n_bad > 0").collect():  # one row per field
        raise IdentityError("; ".join(f"{r['field']}: {r['n_bad']} rows" for r in bad))


class CompactedTable:
    """The latest judged answer per id in bucketed folders; a batch rewrites only the buckets it touches.

    Each version of a bucket is a folder of its own named by the batch, written before it is pointed
    at, so a batch that is run again after a failure gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.current: dict[int, str] = {}

    def read(self, only: set[int] | None = None) -> DataFrame:
        paths = [f"{p}/bucket={b}" for b, p in self.current.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        new = compacted(batch).withColumn("bucket", bucket)
        touched = {r[0] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        if not touched:
            return
        merged = compacted(self.read(touched).unionByName(new.drop("bucket"))).withColumn("bucket", bucket)
        to = f"{self.path}/batch-{batch_id}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(to)
        self.current |= dict.fromkeys(touched, to)


def compact_stream(stream: DataFrame, target: CompactedTable, checkpoint: str, identity: dict[str, str] | None = None) -> Any:
    """Starts a query that folds each batch into the table, after the identity gate; runs what is there, then ends."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        if identity:
            check_identity(batch, identity)
        target.upsert(batch, batch_id)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(stream: DataFrame, by: str = "source") -> DataFrame:
    """(by, scored, right) as a stateful aggregate; complete mode."""
    return stream.groupBy(by).agg(F.count("correct").alias("scored"), F.count_if("correct").alias("right"))


def stalled(stream: DataFrame, by: str, at: str, minutes: int, delay: str = "1 day") -> DataFrame:
    """(by, last_at, gap_minutes): gaps of more than ``minutes`` between a key's rows, in event time.

    Custom state per key: the time of its last row. Rows of a key within a batch are taken in order.
    """
    schema = f"{by} string, last_at timestamp, gap_minutes double"

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = pd.concat([b[at] for b in batches]).sort_values()
        last = state.get[0] if state.exists else None
        out = []
        for t in times:
            if last is not None and (t - last).total_seconds() > 60 * minutes:
                out.append((key[0], last, (t - last).total_seconds() / 60))
            last = t if last is None or t > last else last
        state.update((last,))
        yield pd.DataFrame(out, columns=[by, "last_at", "gap_minutes"])

    return stream.withWatermark(at, delay).groupBy(by).applyInPandasWithState(of, schema, "last_at timestamp", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, by, n): tumbling windows with late data up to ``delay``."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), by, "n")


def sidecar_problems(log: DataFrame, batch: str, fields: list[str], kept: dict[str, str]) -> DataFrame:
    """(batch, field, problem): the identity kept beside a run against each batch's, both ways."""
    per = log.groupBy(batch).agg(*[F.min(f).alias(f) for f in fields])
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    want = F.create_map(*[F.lit(x) for kv in sorted(kept.items()) for x in kv])
    missing = F.transform(F.array(*[F.lit(k) for k in sorted(kept) if k not in fields]), lambda k: F.struct(k.alias("field"), F.lit("missing").alias("problem")))
    told = F.transform(found, lambda x: F.struct(x["field"].alias("field"), F.when(~F.map_contains_key(want, x["field"]), "foreign").when(~F.equal_null(F.try_element_at(want, x["field"]), x["value"]), "differs").alias("problem")))
    rows = per.select(batch, F.explode(F.concat(told, missing)).alias("p"))
    return rows.select(batch, "p.field", "p.problem").where(F.col("problem").isNotNull())


def batches(log: DataFrame, batch: str, key: str, answered: Column) -> DataFrame:
    """(batch, ids, answered, complete): a batch is complete if each of its identifiers was answered."""
    ids = log.groupBy(batch, key).agg(F.max(answered.cast("int")).alias("answered"))
    return ids.groupBy(batch).agg(F.count(F.lit(1)).alias("ids"), F.sum("answered").alias("answered"), (F.sum("answered") == F.count(F.lit(1))).alias("complete"))
