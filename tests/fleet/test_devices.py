from pyspark.sql import functions as F

from fleetlake.sources import titles


def test_reports_are_written_by_parts_of_bounded_size(spark, tmp_path):
    """Rows are dealt anew, a title to several tasks, before the sort by title that the writer needs."""
    names = list(titles._DEVICE)
    df = spark.range(0, 60_000, 1, 8).select(*(F.sha2(F.concat(F.lit(c), "id"), 256).alias(c) for c in names), (F.col("id") % 3).cast("string").alias("title_id")).withColumn("lastContactTime", F.lit("2020-01-01 00:00:00"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        titles.write_device_reports(df, str(tmp_path / "devices"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "devices").glob("*/*.csv"))) > 3
    assert titles.read_device_reports(spark, str(tmp_path / "devices")).groupBy("title_id").count().orderBy("title_id").collect() == [("0", 20_000), ("1", 20_000), ("2", 20_000)]
