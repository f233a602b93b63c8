"""Tables written into the folder that all executors share.

Iterative and multi-pass operators cut their lineage here: a lost executor then costs a
re-read of Parquet, never a recomputation of earlier rounds. The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
temporary folder of this machine is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one only where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    made = tempfile.mkdtemp(prefix="assayer-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _of_session(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/assayer/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_of_session(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results not yet read are lost."""
    delete(spark, _of_session(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with a lineage of one scan."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _path_and_system(spark, path)
    system.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _path_and_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of its file system, so that others than Spark open the same one."""
    p, system = _path_and_system(spark, path)
    return system.makeQualified(p).toString()


def folders(spark: SparkSession, path: str, name: str) -> set[int]:
    """The numbers of the partition folders ``name=number`` below path, by listing it."""
    p, system = _path_and_system(spark, path)
    names = [x.getPath().getName() for x in system.listStatus(p)]
    return {int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=")}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared folder, in whole or not at all."""
    p, system = _path_and_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(part, p):
        raise OSError(f"not written: {path}")


def read_text(spark: SparkSession, path: str) -> str:
    p, system = _path_and_system(spark, path)
    source = system.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()
