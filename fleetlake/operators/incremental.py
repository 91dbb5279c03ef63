"""Trends kept up as snapshots arrive: a new one is merged into partial aggregates, history is not read again.

The state has two tables. ``releases`` holds sums for each title and release date, from which the
adoption, frequency, completion and time-to-patch trends follow; ``latest`` holds each title's last
entries, on which staleness rests. Every update writes a new partition ``as_of`` of both, named by
the newest snapshot in it, and leaves the ones before untouched, so a run that fails leaves the state
as it was and is simply repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import floor_days, half_even, percent_text, released_at

#: Entries of each title that staleness may ask for.
KEPT = 3
_STAMP = "yyyy-MM-dd HH-mm-ss.SSSSSS"


def release_sums(snaps: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(title, at, hundredths, n, crossings, days, first): what a set of snapshots adds for each title and release date ``at``.

    ``hundredths`` and ``n`` add up completion percentages, ``crossings`` and ``days`` the entries at or
    above the threshold and their days since the release, ``first`` is the earliest of these. Rows of a
    release that does not parse have a null ``at`` and no crossings.
    """
    df = snaps.where("title is not null").withColumn("at", released_at("released"))
    crossed = F.col("at").isNotNull() & (F.col("completion_percent") >= threshold)
    days = floor_days(F.col("snapshot_ts"), F.col("at"))
    return df.groupBy("title", "at").agg(
        F.coalesce(F.sum(F.round(100 * F.col("completion_percent")).cast("long")), F.lit(0)).alias("hundredths"), F.count("completion_percent").alias("n"),
        F.count_if(F.coalesce(crossed, F.lit(False))).alias("crossings"), F.coalesce(F.sum(F.when(crossed, days)), F.lit(0)).alias("days"),
        F.min(F.when(crossed, F.struct("snapshot_ts", days.alias("days")))).alias("first"),
    )


def merge_sums(*parts: DataFrame) -> DataFrame:
    """Release sums of disjoint sets of snapshots, added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("title", "at").agg(*(F.sum(c).alias(c) for c in ("hundredths", "n", "crossings", "days")), F.min("first").alias("first"))


def latest_entries(snaps: DataFrame, kept: int = KEPT) -> DataFrame:
    """(title, snapshot_ts, title_id, latest_version, completion_percent): the last ``kept`` entries of each title."""
    columns = ("title", "snapshot_ts", "title_id", "latest_version", "completion_percent")
    last = Window.partitionBy("title").orderBy(F.desc("snapshot_ts"), F.desc("title_id"))
    return snaps.where("title is not null").select(*columns).withColumn("r", F.row_number().over(last)).where(F.col("r") <= kept).select(*columns)


def _newest(spark: SparkSession, path: str) -> str | None:
    """The newest complete ``as_of`` of a state; only folder names are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/latest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    # ``latest`` is written last, so a state that has it is whole
    done = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("as_of=")]
    return max((p.getName().removeprefix("as_of=") for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=None)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(releases, latest) of the newest state under ``path``."""
    as_of = _newest(spark, path)
    if as_of is None:
        raise ValueError("there is no state yet")
    return tuple(spark.read.parquet(f"{path}/{t}/as_of={as_of}") for t in ("releases", "latest"))


def update_trends(snaps: DataFrame, path: str, threshold: float = 80.0, kept: int = KEPT) -> str | None:
    """Merge what is newer than the state under ``path`` into it; returns the new as_of, or None if there is nothing new.

    ``snaps`` is the snapshot table, whose column ``snapshot_date``, where it has one, keeps the scan to
    the partitions that can hold newer snapshots. Snapshots that arrive with a time before the newest
    one are not taken in; rebuild the state for them. One state has one threshold and one ``kept``.
    """
    spark = snaps.sparkSession
    as_of = _newest(spark, path)
    if as_of is not None:
        last = datetime.strptime(as_of, "%Y-%m-%d %H-%M-%S.%f")
        if "snapshot_date" in snaps.columns:
            snaps = snaps.where(F.col("snapshot_date") >= F.lit(last.date()))
        snaps = snaps.where(F.col("snapshot_ts") > F.lit(last.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    new = snaps.agg(F.date_format(F.max("snapshot_ts"), _STAMP)).first()[0]
    if new is None:
        return None
    releases, latest = release_sums(snaps, threshold), latest_entries(snaps, kept)
    if as_of is not None:
        sums, entries = read_state(spark, path)
        releases, latest = merge_sums(sums, releases), latest_entries(entries.unionByName(latest), kept)
    releases.write.mode("overwrite").parquet(f"{path}/releases/as_of={new}")
    latest.write.mode("overwrite").parquet(f"{path}/latest/as_of={new}")
    return new


def _mean(total: str, n: str):
    """The mean of hundredths as in ``mean_of_hundredths``: exact, ties to even."""
    t, n = F.col(total), F.col(n)
    whole, rest = F.floor(F.abs(t) / n), F.abs(t) % n
    up = (2 * rest > n) | ((2 * rest == n) & (whole % 2 == 1))
    return F.when(n > 0, F.signum(t) * (whole + up.cast("long")) / 100)


def patch_adoption(releases: DataFrame) -> DataFrame:
    df = releases.groupBy("title").agg(F.sum("hundredths").alias("h"), F.sum("n").alias("n"), F.max("at").alias("last"))
    return df.select("title", percent_text(_mean("h", "n")).alias("completion_percent"), F.date_format("last", "yyyy-MM-dd").alias("released"))


def release_frequency(releases: DataFrame) -> DataFrame:
    return releases.groupBy("title").agg(F.count("at").alias("release_count"))


def completion_trends(releases: DataFrame) -> DataFrame:
    return releases.where("at is not null").select(F.date_format("at", "yyyy-MM-dd").alias("released"), "title", percent_text(_mean("hundredths", "n")).alias("completion_percent"))


def time_to_patch(releases: DataFrame, threshold: float = 80.0, first_crossing_only: bool = False) -> DataFrame:
    """``threshold`` is that with which the state was built."""
    df = releases.where("trim(title) <> '' and crossings > 0").groupBy("title").agg(F.sum("days").alias("days"), F.sum("crossings").alias("n"), F.min("first").alias("first"))
    days, n = (F.col("first.days").cast("double"), F.lit(1).cast("long")) if first_crossing_only else (half_even(F.col("days") / F.col("n")), F.col("n"))
    return df.select("title", days.alias("avg_days"), n.alias("sample_size"), F.lit(float(threshold)).alias("threshold"))


def excluded_titles(releases: DataFrame) -> DataFrame:
    df = releases.where("trim(title) <> ''").groupBy("title").agg(F.sum("crossings").alias("n"))
    return df.agg(F.count_if(F.col("n") == 0).alias("excluded"))
