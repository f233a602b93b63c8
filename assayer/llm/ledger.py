"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger is two tables in buckets of the key's hash: ``members`` (key, id) and ``classes``
(key, number of ids, earliest representative). A new batch is aggregated to the same shape and
full-outer-joined with the buckets it touches, and only with those; counts are added, the earliest
representative is retained, and the touched buckets are written anew beside the old ones. A small
manifest, a JSON file in the shared folder, says which path holds a bucket, so buckets that a batch
does not touch are never read, and any later session opens the ledger by the manifest's path and
folds the next batch into it. A manifest is never changed: each fold writes the next one.

The number of buckets is a power of two that follows the size: once a bucket would hold more
than ROWS_PER_BUCKET members on average, the ledger is written anew with twice as many or more. A
batch small beside the ledger thus touches few of them.

An id is counted once per state however often it was delivered: what a batch adds to a class is the
number of its ids that ``members`` did not hold. Heavy classes cost no more than light ones, as
every step aggregates before it shuffles and members are spread by (key, id).

Defined results: null states and null ids are left out; states without any word form one class; an
id with several states is a member of several classes; an empty batch leaves the ledger as it is;
of equally early rows the smallest id represents the class; extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.canonical import canonical_column, key_column
from assayer.plans.lineage import folders, new_path, read_text, write_text
from assayer.plans.skew import join_by_counted_key

#: Least buckets, and members that a bucket holds on average before there are more of them.
BUCKETS, ROWS_PER_BUCKET = 32, 500_000
MEMBERS = "bucket int, key binary, id string, n_rows long, first_at timestamp"
CLASSES = "bucket int, key binary, n_ids long, n_rows long, keep_id string, first_id string, first_at timestamp"


def keyed(rows: DataFrame, text: str = "state", id_: str = "id", at: str = "ingested_at") -> DataFrame:
    """(id, key, first_at) of each row that has a text."""
    rows = rows.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(at).cast("timestamp").alias("first_at"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.select("id", key_column(canonical_column("text")).alias("key"), "first_at")


def _write(rows: DataFrame, name: str) -> str:
    """rows in a folder per bucket; few files each, and a bucket grown large in several."""
    path = new_path(rows.sparkSession, name)
    rows.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return path


@dataclass
class Ledger:
    """Paths of the bucketed tables, by bucket, and how many members they hold."""

    spark: SparkSession
    buckets: int = BUCKETS
    rows: int = 0
    members: dict[int, str] = field(default_factory=dict)
    classes: dict[int, str] = field(default_factory=dict)

    def save(self) -> str:
        """Writes the manifest; gives its path."""
        path = new_path(self.spark, "ledger-manifest") + ".json"
        write_text(self.spark, path, json.dumps({"buckets": self.buckets, "rows": self.rows, "members": self.members, "classes": self.classes}))
        return path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger of a manifest, in whatever session."""
        told = json.loads(read_text(spark, path))
        by_bucket = lambda d: {int(k): v for k, v in d.items()}
        return cls(spark, told["buckets"], told["rows"], by_bucket(told["members"]), by_bucket(told["classes"]))

    def grown(self, rows: int, rows_per_bucket: int) -> Ledger:
        """The ledger with buckets enough for so many members."""
        buckets = self.buckets
        while buckets * rows_per_bucket < rows:
            buckets *= 2
        if buckets == self.buckets:
            return self
        if not self.members:
            return Ledger(self.spark, buckets)
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        paths = []
        for df, name in ((self.all_members(), "ledger-members"), (self.all_classes(), "ledger-classes")):
            path = _write(df.withColumn("bucket", bucket), name)
            paths.append(dict.fromkeys(folders(self.spark, path, "bucket"), path))
        return Ledger(self.spark, buckets, self.rows, *paths)

    def _read(self, paths: dict[int, str], schema: str, only: set[int] | None = None) -> DataFrame:
        wanted = {b: p for b, p in paths.items() if only is None or b in only}
        parts = [self.spark.read.schema(schema).parquet(p).where(F.col("bucket").isin([b for b, q in wanted.items() if q == p])) for p in dict.fromkeys(wanted.values())]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def all_members(self) -> DataFrame:
        return self._read(self.members, MEMBERS)

    def all_classes(self) -> DataFrame:
        return self._read(self.classes, CLASSES)

    def fold(self, batch: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> Ledger:
        """The ledger with a batch of ``keyed`` rows added."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        fresh = batch.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("first_at").alias("first_at"))
        stage = _write(fresh.withColumn("bucket", bucket), "ledger-batch")
        fresh = self.spark.read.schema(MEMBERS).parquet(stage)
        n = fresh.count()
        if not n:
            return self
        grown = self.grown(self.rows + n, rows_per_bucket)
        if grown is not self:
            bucket = F.pmod(F.xxhash64("key"), F.lit(grown.buckets)).cast("int")
            stage = _write(fresh.withColumn("bucket", bucket), "ledger-batch")
            fresh = self.spark.read.schema(MEMBERS).parquet(stage)
        return grown._add(fresh, stage)

    def _add(self, fresh: DataFrame, stage: str) -> Ledger:
        touched = folders(self.spark, stage, "bucket")
        if not self.members:
            held = fresh
            members_path = stage
            added = held
        else:
            old = self._read(self.members, MEMBERS, touched).alias("o")
            pair = old.join(fresh.alias("b"), ["bucket", "key", "id"], "full_outer")
            held = pair.select(
                "bucket", "key", "id",
                (F.coalesce("o.n_rows", F.lit(0)) + F.coalesce("b.n_rows", F.lit(0))).alias("n_rows"),
                F.least("o.first_at", "b.first_at").alias("first_at"),
                F.when(F.col("o.n_rows").isNull(), 1).otherwise(0).alias("new"),
                F.col("b.n_rows").alias("batch_rows"),
            )
            members_path = _write(held, "ledger-members")
            held = self.spark.read.schema(MEMBERS + ", new int, batch_rows long").parquet(members_path)
            added = held.where(F.col("batch_rows").isNotNull())
        classes = self._add_classes(added, touched)
        new = added.agg(F.sum("new")).first()[0] if "new" in added.columns else added.count()
        return Ledger(self.spark, self.buckets, self.rows + new, self.members | dict.fromkeys(touched, members_path), classes)

    def _add_classes(self, added: DataFrame, touched: set[int]) -> dict[int, str]:
        new = F.col("new") if "new" in added.columns else F.lit(1)
        rows = F.col("batch_rows") if "batch_rows" in added.columns else F.col("n_rows")
        earliest = F.struct(F.coalesce("first_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), "id")
        batch = added.groupBy("bucket", "key").agg(F.sum(new).alias("n_ids"), F.sum(rows).alias("n_rows"), F.min("id").alias("keep_id"), F.min(earliest).alias("first"))
        if not self.classes:
            first = batch.select("bucket", "key", "n_ids", "n_rows", "keep_id", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))
            return dict.fromkeys(touched, _write(first, "ledger-classes"))
        old = self._read(self.classes, CLASSES, touched).select("bucket", "key", "n_ids", "n_rows", "keep_id", F.struct(F.coalesce("first_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), F.col("first_id").alias("id")).alias("first"))
        both = old.alias("o").join(batch.alias("b"), ["bucket", "key"], "full_outer")
        total = lambda c: (F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).cast("long").alias(c)
        first = F.least("o.first", "b.first")
        out = both.select("bucket", "key", total("n_ids"), total("n_rows"), F.least("o.keep_id", "b.keep_id").alias("keep_id"), first.getField("id").alias("first_id"), first.getField("at").alias("first_at"))
        return self.classes | dict.fromkeys(touched, _write(out, "ledger-classes"))


def in_batches(rows: DataFrame, at: str = "ingested_at") -> list[DataFrame]:
    """Two batches: what was stored before the last day of delivery, and that day."""
    last = rows.agg(F.date_trunc("day", F.max(at))).first()[0]
    if last is None:
        return [rows]
    new = F.col(at) >= F.lit(last)
    return [rows.where(~new | F.col(at).isNull()), rows.where(new)]


def build(rows: DataFrame, buckets: int = BUCKETS) -> Ledger:
    """A ledger of all rows, folded batch by batch; between two batches it is opened by its manifest, as on another day."""
    spark = rows.sparkSession
    path = Ledger(spark, buckets).save()
    for batch in in_batches(rows):
        path = Ledger.open(spark, path).fold(keyed(batch)).save()
    return Ledger.open(spark, path)


def duplicates(ledger: Ledger) -> DataFrame:
    """(keep_id, dup_id): the smallest id of each class of two ids or more, with each other id."""
    shared = ledger.all_classes().where(F.col("n_ids") > 1).select("key", "n_ids", "keep_id")
    total = shared.agg(F.sum("n_ids")).first()[0] or 0
    members = ledger.all_members().select("key", F.col("id").alias("dup_id"))
    return join_by_counted_key(members, shared, "key", "n_ids", total).where(F.col("dup_id") != F.col("keep_id")).select("keep_id", "dup_id").distinct()
