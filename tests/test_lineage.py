from pyspark.sql import functions as F

from assayer.plans import lineage


def test_written_tables_have_a_short_lineage_and_can_be_cleared(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    back = lineage.written(df, "t")
    assert back.dtypes == df.dtypes and back.exceptAll(df).isEmpty()
    assert "Aggregate" not in back._jdf.queryExecution().executedPlan().toString()
    path = lineage.new_path(spark, "x")
    spark.range(1).write.parquet(path)
    lineage.delete(spark, path)
    assert spark.sparkContext.applicationId in path and path.startswith(lineage.shared_dir(spark))


def test_small_files(spark):
    path = lineage.new_path(spark, "small") + ".json"
    lineage.write_text(spark, path, '{"a": "ä"}')
    assert lineage.read_text(spark, path) == '{"a": "ä"}'
