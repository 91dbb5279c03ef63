"""Dated snapshots of title rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETENTION_DAYS = 90


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names lower-cased, spaces as underscores."""
    return df.toDF(*(c.lower().replace(" ", "_") for c in df.columns))


def read_snapshots(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", min_snapshots: int = 0) -> DataFrame:
    """All snapshot files as one frame with ``snapshot_ts``.

    The time is the snapshot_ts column or partition where there is one, else the yyyyMMddHHmm in a
    name like patch_data_202401051230.parquet, else the file's modification time. Raises if there are
    fewer than ``min_snapshots`` distinct times.
    """
    reader = spark.read.option("mergeSchema", "true") if fmt == "parquet" else spark.read.option("header", "true")
    df = reader.format(fmt).load(paths)
    stamp = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{12})(?=\.[^.]+$|\.)", 1), F.lit("yyyyMMddHHmm"))
    if "snapshot_ts" not in [c.lower().replace(" ", "_") for c in df.columns]:
        df = df.withColumn("snapshot_ts", F.coalesce(stamp, F.col("_metadata.file_modification_time")))
    df = normalize_columns(df)
    df = df.withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))
    if min_snapshots and df.select("snapshot_ts").distinct().limit(min_snapshots).count() < min_snapshots:
        raise ValueError(f"at least {min_snapshots} snapshots are needed")
    return df


def write_snapshot(titles: DataFrame, path: str, as_of: Column | datetime) -> None:
    """Append one full snapshot, in a folder for its date; ``sources`` becomes a JSON string."""
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)
    df = titles.withColumn("snapshot_ts", stamp.cast("timestamp"))
    if dict(df.dtypes).get("sources", "").startswith("map"):
        df = df.withColumn("sources", F.to_json("sources"))
    df.withColumn("snapshot_date", F.to_date("snapshot_ts")).write.mode("append").partitionBy("snapshot_date").parquet(path)


def expire_snapshots(snaps: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Snapshots no older than ``days`` before ``as_of``; a filter that prunes date partitions where they are kept."""
    oldest = as_of - F.make_dt_interval(F.lit(days))
    out = snaps.where(F.col("snapshot_ts") >= oldest)
    return out.where(F.col("snapshot_date") >= F.to_date(oldest)) if "snapshot_date" in snaps.columns else out
