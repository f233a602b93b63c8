"""JSON-lines and text sources with the guards that sealed data needs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION = T.StructType([T.StructField(c, T.StringType()) for c in ("label", "key", "description")])
RECORD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "source", "group_id", "kind", "state", "question")],
        T.StructField("options", T.ArrayType(OPTION)),
        *[T.StructField(c, T.StringType()) for c in ("answer", "answer_key", "split")],
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    ]
)
MESSAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])


class SourceError(ValueError):
    pass


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """One object per line; only \\n ends a line (a line separator inside a string does not). Bad lines fail the read."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tree(spark: SparkSession, root: str, pattern: str, schema: T.StructType, exclude: str | None = None) -> DataFrame:
    """All files below root that match a glob, with ``file``; files whose path matches ``exclude`` are left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").json(root)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    return rows.where(~F.col("file").rlike(exclude)) if exclude else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one file, in order; the file is read whole by one task, as order needs."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.col("value") != "")


def read_repaired(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, (line, problem)) of a log that may have been cut off while it was written.

    A broken last line is reported as 'tail' and dropped; a broken line before it is an error of the
    file, reported as 'middle'. Nothing is collected; see ``repaired_or_fail``.
    """
    lines = numbered_lines(spark, path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    last = F.max("line").over(Window.partitionBy(F.lit(0)))
    marked = parsed.withColumn("bad", F.col("row").isNull() | F.col("row._corrupt").isNotNull()).withColumn("last", F.col("line") == last)
    good = marked.where(~F.col("bad")).select("line", "row.*").drop("_corrupt")
    problems = marked.where("bad").select("line", F.when(F.col("last"), "tail").otherwise("middle").alias("problem"))
    return good, problems


def repaired_or_fail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    good, problems = read_repaired(spark, path, schema)
    if broken := problems.where("problem = 'middle'").orderBy("line").take(5):
        raise SourceError(f"{path}: broken lines {[r['line'] for r in broken]} before the end")
    return good


def read_bounded(spark: SparkSession, path: str, schema: T.StructType, sha256: str | None = None, most_bytes: int = 1 << 30, most_line: int = 1 << 20, most_rows: int = 10_000_000) -> DataFrame:
    """A file that must be what it claims: size, digest, line length, rows and schema, else SourceError.

    Size and digest come from the file as a whole, so this is for sealed files, not for a lake.
    """
    length = spark.read.format("binaryFile").load(path).select("length").collect()
    if len(length) != 1:
        raise SourceError(f"{path}: {len(length)} files")
    if length[0]["length"] > most_bytes:
        raise SourceError(f"{path}: {length[0]['length']} bytes")
    if sha256 is not None and spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] != sha256:
        raise SourceError(f"{path}: other content than expected")
    widest, n = spark.read.option("lineSep", "\n").text(path).agg(F.max(F.octet_length("value")), F.count(F.lit(1))).first()
    if (widest or 0) > most_line or n > most_rows:
        raise SourceError(f"{path}: line of {widest} bytes, {n} rows")
    return read_jsonl(spark, path, schema)


def read_set(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Distinct values of a text file, stripped, blanks dropped; words of it with ``split``."""
    lines = spark.read.text(path)
    values = lines.select(F.explode(F.split("value", r"\s+")).alias("value")) if split else lines
    return values.select(F.trim("value").alias("value")).where(F.col("value") != "").distinct()


def read_pairs(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """Distinct pairs of a tab-separated file, cut at the first tab only."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(cut[0].alias(a), cut[1].alias(b)).distinct()


def read_pool(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several splits of a snapshot in one table, with ``pool_split``."""
    parts = [spark.read.parquet(p).withColumn("pool_split", F.lit(name)) for name, p in sorted(paths.items())]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def load_manifest(path: str, most_bytes: int = 1 << 20) -> dict:
    """A JSON document on the driver; repeated names and oversized files are refused."""
    raw = Path(path).read_bytes()
    if len(raw) > most_bytes:
        raise SourceError(f"{path}: {len(raw)} bytes")

    def once(pairs: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in pairs]
        if len(set(names)) != len(names):
            raise SourceError(f"{path}: repeated name in {names}")
        return dict(pairs)

    return json.loads(raw, object_pairs_hook=once)
