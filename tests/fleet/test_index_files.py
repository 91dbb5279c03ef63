"""A trigram that every app holds makes a large shard; it is not written by one task."""

from pyspark.sql import functions as F

from fleetlake.operators import catalog, search


def test_a_large_shard_is_written_by_several_tasks(spark, tmp_path):
    apps = spark.range(0, 6000, 1, 4).select(F.concat(F.lit("app"), F.sha2(F.col("id").cast("string"), 256)).alias("slug"), *(F.lit(None).cast("string").alias(c) for c in ("name", "vendor", "bundle_id")))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        path = str(tmp_path / "index")
        search.write_search_index(apps, path, 1)
    finally:
        for k in conf:
            spark.conf.unset(k)
    postings = spark.read.parquet(f"{path}/postings")
    files = postings.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and max(r["count"] for r in files) < postings.count() / 2
    assert postings.groupBy("gram", "slug").count().where("count > 1").isEmpty()
    some = apps.first().slug[5:12]
    assert search.search_indexed(apps, path, some, 100).collect() == catalog.search_apps(apps, some, 100).collect() != []
