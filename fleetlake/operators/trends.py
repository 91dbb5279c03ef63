"""Trends across snapshots; all share the grouping key ``title``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import floor_days, half_even, mean_of_hundredths, percent_text, released_at


def patch_adoption(snaps: DataFrame) -> DataFrame:
    """(title, completion_percent, released): mean completion as text and the latest release date of each title."""
    return (
        snaps.where("title is not null").groupBy("title")
        .agg(mean_of_hundredths("completion_percent").alias("mean"), F.max(released_at("released")).alias("last"))
        .select("title", percent_text("mean").alias("completion_percent"), F.date_format("last", "yyyy-MM-dd").alias("released"))
    )


def release_frequency(snaps: DataFrame) -> DataFrame:
    """(title, release_count): distinct release dates."""
    return snaps.where("title is not null").groupBy("title").agg(F.countDistinct(released_at("released")).alias("release_count"))


def completion_trends(snaps: DataFrame) -> DataFrame:
    """(released, title, completion_percent): mean completion for each release date and title."""
    df = snaps.select(released_at("released").alias("at"), "title", "completion_percent").where("at is not null and title is not null")
    return df.groupBy("at", "title").agg(mean_of_hundredths("completion_percent").alias("mean")).select(F.date_format("at", "yyyy-MM-dd").alias("released"), "title", percent_text("mean").alias("completion_percent"))


def _crossings(snaps: DataFrame, threshold: float) -> DataFrame:
    df = snaps.withColumn("at", released_at("released")).where((F.trim("title") != "") & F.col("at").isNotNull() & (F.col("completion_percent") >= threshold))
    return df.withColumn("days", floor_days(F.col("snapshot_ts"), F.col("at")))


def time_to_patch(snaps: DataFrame, threshold: float = 80.0, first_crossing_only: bool = False) -> DataFrame:
    """(title, avg_days, sample_size, threshold) over the snapshots at or above the threshold, or the first of them."""
    df = _crossings(snaps, threshold).groupBy("title")
    days, n = (F.min_by("days", "snapshot_ts").cast("double"), F.lit(1).cast("long")) if first_crossing_only else (half_even(F.avg("days")), F.count("*"))
    return df.agg(days.alias("avg_days"), n.alias("sample_size")).withColumn("threshold", F.lit(float(threshold)))


def stale_apps(snaps: DataFrame, min_snapshots: int = 3, ord: str = "title_id") -> DataFrame:
    """Titles whose last ``min_snapshots`` entries have one version and one completion; (title, latest_version, completion_percent, days_stale)."""
    w = Window.partitionBy("title").orderBy(F.desc("snapshot_ts"), F.desc(ord))
    df = snaps.where("title is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= min_snapshots)
    df = df.select("title", "snapshot_ts", F.coalesce("latest_version", F.lit("")).alias("version"), F.coalesce(half_even("completion_percent"), F.lit(0.0)).alias("pct"))
    out = df.groupBy("title").agg(F.count("*").alias("n"), F.min("version").alias("v"), F.max("version").alias("v2"), F.min("pct").alias("p"), F.max("pct").alias("p2"), F.min("snapshot_ts").alias("a"), F.max("snapshot_ts").alias("b"))
    return out.where((F.col("n") == min_snapshots) & (F.col("v") == F.col("v2")) & (F.col("p") == F.col("p2"))).select("title", F.col("v").alias("latest_version"), F.col("p").alias("completion_percent"), floor_days(F.col("b"), F.col("a")).alias("days_stale"))


def excluded_titles(snaps: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(excluded): how many titles never cross the threshold."""
    df = snaps.where(F.trim("title") != "").groupBy("title").agg(F.max((F.col("completion_percent") >= threshold) & released_at("released").isNotNull()).alias("crossed"))
    return df.agg(F.count_if(~F.coalesce("crossed", F.lit(False))).alias("excluded"))


def sort_trend(df: DataFrame, sort_by: str | None, ascending: bool = True) -> DataFrame:
    """Sorted by an output column, title as the tie-breaker; an unknown column raises."""
    if sort_by is None:
        return df
    name = sort_by.lower().replace(" ", "_")
    if name not in df.columns:
        raise ValueError(f"no such column: {sort_by}")
    return df.orderBy(F.col(name).asc() if ascending else F.col(name).desc(), "title")


TRENDS: dict[str, Callable[..., DataFrame]] = {f.__name__.replace("_", "-"): f for f in (patch_adoption, release_frequency, completion_trends, time_to_patch, stale_apps)}


def trend_criteria() -> list[str]:
    return list(TRENDS)


def apply_trend(snaps: DataFrame, name: str, sort_by: str | None = None, ascending: bool = True) -> DataFrame:
    """A trend by its kebab-case name, over at least two snapshots."""
    if name not in TRENDS:
        raise ValueError(f"unknown trend: {name}")
    if snaps.select("snapshot_ts").distinct().limit(2).count() < 2:
        raise ValueError("at least two snapshots are needed")
    return sort_trend(TRENDS[name](snaps), sort_by, ascending)
