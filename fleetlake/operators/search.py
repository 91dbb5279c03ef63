"""Catalog search over stored trigrams, and pages of a stored catalog that start after a slug."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import search_apps

FIELDS = ("slug", "name", "vendor", "bundle_id")
#: Of a query's trigrams, so many of the rarest are looked up.
RAREST = 3


def trigrams(text: str) -> list[str]:
    """The trigrams that every field an ilike pattern of ``text`` fits must hold in lower case: those of its ASCII runs between wildcards."""
    runs = re.findall(r"[^%_\\\x80-\U0010ffff]{3,}", text)
    return sorted({r[i : i + 3].lower() for r in runs for i in range(len(r) - 2)})


def _grams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def write_search_index(apps: DataFrame, path: str, shards: int = 64) -> None:
    """Postings (gram, slug) of all trigrams of the searched fields in lower case, in one folder for each hash shard and sorted by trigram; and (gram, n).

    A shard that outgrows Spark's advisory size (one frequent trigram can) is written by several tasks, a sorted file each.
    """
    rows = apps.select("slug", F.explode(F.array_distinct(F.concat(*(_grams(F.lower(c)) for c in FIELDS)))).alias("gram")).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int"))
    rows.hint("rebalance", F.col("shard")).sortWithinPartitions("shard", "gram", "slug").write.partitionBy("shard").parquet(f"{path}/postings")
    counts = apps.sparkSession.read.parquet(f"{path}/postings").groupBy("shard", "gram").agg(F.count("*").alias("n"))
    counts.repartition("shard").sortWithinPartitions("shard", "gram").write.partitionBy("shard").parquet(f"{path}/counts")
    apps.sparkSession.createDataFrame([(shards,)], "shards int").coalesce(1).write.json(f"{path}/layout")


def _wanted(spark: SparkSession, path: str, table: str, grams: list[str], shards: int) -> DataFrame:
    """The rows of the trigrams; only their shards are listed, and within these the filter reaches the scan."""
    of = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int").alias("s")).distinct()
    return spark.read.parquet(f"{path}/{table}").where(F.col("shard").isin([r.s for r in of.collect()]) & F.col("gram").isin(grams))


def search_indexed(apps: DataFrame, path: str, query: str, limit: int = 20) -> DataFrame:
    """The rows of ``search_apps``: the slugs that the query's rarest trigrams share, then the same test on these alone.

    Queries without three ASCII characters in a row are answered by the scan. ``apps`` and the index hold
    the same apps.
    """
    grams = trigrams(query)
    if not grams:
        return search_apps(apps, query, limit)
    spark = apps.sparkSession
    shards = spark.read.json(f"{path}/layout").first()["shards"]
    found = {r["gram"]: r["n"] for r in _wanted(spark, path, "counts", grams, shards).collect()}  # a row for each trigram of the query
    if len(found) < len(grams):
        return apps.limit(0)
    rare = sorted(grams, key=found.get)[:RAREST]
    slugs = _wanted(spark, path, "postings", rare, shards).groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
    return search_apps(apps.join(slugs, "slug", "left_semi").select(apps.columns), query, limit)


def write_catalog(apps: DataFrame, path: str, files: int = 64) -> None:
    """The catalog in files of neighbouring slugs, sorted, with the first and last slug and the rows of each file beside it."""
    apps.repartitionByRange(files, "slug").sortWithinPartitions("slug").write.parquet(f"{path}/apps")
    rows = apps.sparkSession.read.parquet(f"{path}/apps").select("slug", F.col("_metadata.file_path").alias("file"))
    rows.groupBy("file").agg(F.min("slug").alias("first"), F.max("slug").alias("last"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/files")


def page_after(spark: SparkSession, path: str, after: str | None = None, limit: int = 100, vendor: str | None = None, source: str | None = None) -> DataFrame:
    """The first ``limit`` apps, 1 to 1000, whose slug comes after ``after``, in slug order; filters as in ``list_apps``.

    Only files that can hold rows of the page are read: as many in slug order as have ``limit`` rows, and
    with filters twice as many again and again until the page is full.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    files = spark.read.parquet(f"{path}/files").orderBy("first")
    later = (files if after is None else files.where(F.col("last") > after)).collect()  # a row for each file
    schema = spark.read.parquet(f"{path}/apps").schema
    wanted = [c for c in ((F.col("slug") > after) if after is not None else None, F.col("vendor").ilike(vendor) if vendor is not None else None, F.array_contains("sources", source) if source is not None else None) if c is not None]
    k, rows = 1, 0
    while k < len(later) and (rows := sum(f["n"] for f in later[1:k])) < limit:
        k += 1  # the first file can hold rows up to ``after``
    while True:
        take = [f["file"] for f in later[:k]]
        page = spark.read.schema(schema).parquet(*take) if take else spark.createDataFrame([], schema)
        page = reduce(DataFrame.where, wanted, page)
        if k >= len(later) or page.select("slug").limit(limit).count() >= limit:
            return page.orderBy("slug").limit(limit)
        k *= 2
