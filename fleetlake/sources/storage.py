"""Shared places, set-based upserts, and bucketed tables of which an upsert rewrites only what changes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a fresh temporary folder where that is unset on one machine (tests). On a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back: computed once, and its plan ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, ord: str | list[Column], name: str) -> DataFrame:
    """``df`` with a long column ``name`` that counts up from 0 in the order of ``ord``, a column or sort columns (ties in any order).

    Rows are dealt by ranges of ``ord`` and counted in each partition; only one count for each partition is gathered.
    """
    ord = [F.col(ord)] if isinstance(ord, str) else ord
    placed = df.repartitionByRange(*ord).sortWithinPartitions(*ord).withColumn("__at", F.monotonically_increasing_id())
    placed = saved(placed, "numbered")
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + place).drop("__part", "__start", "__at")


def left_join_spread(left: DataFrame, right: DataFrame, key: str, row: str) -> DataFrame:
    """``left`` left-joined to ``right`` by a text ``key`` that many rows of ``left`` lack: these meet nothing and are dealt by ``row`` instead of all to one task."""
    left = left.withColumn("__key", F.coalesce(key, F.concat(F.lit("\0"), row)))
    right = right.withColumnRenamed(key, "__right")
    return left.join(right, (F.col("__key") == F.col("__right")) & F.col(key).isNotNull(), "left").drop("__key", "__right")


def latest_by(df: DataFrame, keys: list[str], ord: str, last: bool = True) -> DataFrame:
    """One row for each key: that with the greatest ``ord`` (or the smallest)."""
    order = F.col(ord).desc_nulls_last() if last else F.col(ord).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """``target`` with the rows of ``updates`` inserted or put in place of those with equal keys; of equal keys the last by ``ord``.

    Columns are the target's. Applying the same updates again changes nothing.
    """
    fresh = latest_by(updates, keys, ord).select(target.columns)
    return target.join(fresh.select(keys), keys, "left_anti").select(target.columns).unionByName(fresh)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write ``df``, a row for each key, as a table of hash buckets, one folder each; the number of buckets is kept beside it."""
    df.sparkSession.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").coalesce(1).write.json(f"{path}/_layout")
    df.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def upsert_bucketed(updates: DataFrame, path: str, ord: str = "ord") -> int:
    """``upsert`` into a bucketed table in place; returns the number of buckets that were rewritten.

    Of updates with equal keys the last by ``ord`` counts. Updates that equal their row already are left
    out, so applying the same updates again touches nothing; only buckets that the others fall into are
    read and written, the rest keep their files. New rows of a bucket are written beside the table
    before the bucket is replaced: a run that fails before that leaves the old rows, one that fails
    while buckets are replaced is mended by repeating it.
    """
    spark = updates.sparkSession
    layout = spark.read.json(f"{path}/_layout").first()
    keys, buckets = layout["keys"], layout["buckets"]
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c != "bucket"]
    fresh = saved(latest_by(updates, keys, ord).select(columns).withColumn("bucket", _bucket(keys, buckets)), "fresh")
    met = [r[0] for r in fresh.select("bucket").distinct().collect()]  # no more than there are buckets
    old = rows.where(F.col("bucket").isin(met))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    wanted = saved(fresh.alias("a").join(old.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("bucket", *keys)] + same, "left_anti"), "wanted")
    changed = [r[0] for r in wanted.select("bucket").distinct().collect()]
    if not changed:
        return 0
    old = rows.where(F.col("bucket").isin(changed))
    kept = old.alias("a").join(wanted.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("bucket", *keys)], "left_anti")
    made = saved(kept.select(*columns, "bucket").unionByName(wanted.select(*columns, "bucket")), "buckets")
    made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.catalog.refreshByPath(f"{path}/rows")
    return len(changed)
