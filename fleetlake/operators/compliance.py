"""Compliance of devices with the latest OS versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.titles import derive_title_metrics


def flatten_os_feed(feed: DataFrame) -> DataFrame:
    """(ord, os_version, product_version, release_date) from OSVersions arrays; a later entry has a greater ord."""
    e = feed.select(F.posexplode("OSVersions").alias("ord", "v"))
    return e.select("ord", F.col("v.OSVersion").alias("os_version"), F.col("v.Latest.ProductVersion").alias("product_version"), F.col("v.Latest.ReleaseDate").alias("release_date"))


def device_os_versions(details: DataFrame) -> DataFrame:
    """(serial_number, os_version) of the records that have both."""
    return details.select(F.col("serialNumber").alias("serial_number"), F.col("osVersion").alias("os_version")).where("serial_number is not null and os_version is not null")


def os_compliance(devices: DataFrame, latest: DataFrame) -> DataFrame:
    """One title row for each major version of the feed that some device runs: on the latest release, or not."""
    feed = latest.groupBy(F.split_part("os_version", F.lit("."), F.lit(1)).alias("major")).agg(F.max_by(F.struct("product_version", "release_date"), "ord").alias("l"))
    runs = devices.select(F.split_part("os_version", F.lit("."), F.lit(1)).alias("major"), "os_version").groupBy("major", "os_version").agg(F.count("*").alias("n"))
    j = runs.join(feed, "major")
    on = F.col("os_version") == F.col("l.product_version")
    out = j.groupBy("major").agg(F.first("l").alias("l"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("hosts_patched"), F.sum(F.when(on, 0).otherwise(F.col("n"))).alias("missing_patch"))
    out = out.select(F.concat(F.lit("iOS "), F.col("l.product_version")).alias("title"), F.lit("iOS").alias("title_id"), F.col("l.release_date").alias("released"), "hosts_patched", "missing_patch", F.col("l.product_version").alias("latest_version"))
    return derive_title_metrics(out)


def append_os_status(titles: DataFrame, os_rows: DataFrame) -> DataFrame:
    return titles.unionByName(os_rows, allowMissingColumns=True)
