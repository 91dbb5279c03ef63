"""Choice of snapshots and the differences between two of them."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_even, mean_of_hundredths

COMPARED = ("completion_percent", "hosts_patched", "total_hosts", "latest_version")


def list_snapshots(snaps: DataFrame) -> DataFrame:
    """(snapshot_ts, label) of the distinct times, oldest first; reads the time column alone."""
    times = snaps.select("snapshot_ts").distinct()
    return times.select("snapshot_ts", F.concat(F.lit("snapshot-"), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("label")).orderBy("snapshot_ts")


def _at(snaps: DataFrame, times: DataFrame) -> DataFrame:
    return snaps.join(F.broadcast(times.select("snapshot_ts")), "snapshot_ts", "left_semi")  # one row


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    return _at(snaps, snaps.agg(F.max("snapshot_ts").alias("snapshot_ts")))


def closest_snapshot(snaps: DataFrame, day: date) -> DataFrame:
    """(snapshot_ts): the time nearest to midnight of the day; the earlier one of two."""
    gap = F.abs(F.unix_micros("snapshot_ts") - F.unix_micros(F.lit(day).cast("timestamp")))
    return snaps.select("snapshot_ts").distinct().orderBy(gap, "snapshot_ts").limit(1)


def closest_snapshots(snaps: DataFrame, wanted: DataFrame, at: str = "at") -> DataFrame:
    """``wanted`` with ``snapshot_ts``, the snapshot time nearest to its time ``at``; the earlier one of two, null without either.

    Times and wanted times are sorted together within months and look back and forth for the nearest
    known one; what lies in other months comes from one row for each month. So the wanted times are
    dealt out once, by month, and no pair of a wanted and a known time is made.
    """
    month = F.date_trunc("month", "t").alias("month")
    known = snaps.select(F.col("snapshot_ts").alias("t")).distinct()
    both = known.withColumn("known", F.lit(True)).union(wanted.select(F.col(at).cast("timestamp")).where(F.col(at).isNotNull()).distinct().select("*", F.lit(False))).select("t", "known", month)
    order = Window.partitionBy("month").orderBy("t", F.desc("known"))
    own = F.when(F.col("known"), F.col("t"))
    near = both.withColumns({"before": F.last(own, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "behind": F.first(own, True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    months = both.groupBy("month").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    line = Window.orderBy("month")  # a row for each month of the calendar that is met
    months = months.select("month", F.last("last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    near = near.where("not known").join(F.broadcast(months), "month").select("t", F.coalesce("before", "earlier").alias("a"), F.coalesce("behind", "later").alias("b"))
    gap = lambda c: F.abs(F.unix_micros(c) - F.unix_micros("t"))
    near = near.select(F.col("t").alias("__t"), F.when(F.col("b").isNull() | (gap("a") <= gap("b")), F.col("a")).otherwise(F.col("b")).alias("snapshot_ts"))
    return wanted.join(near, F.col(at).cast("timestamp") == F.col("__t"), "left").drop("__t")


def parse_window(text: str) -> timedelta:
    """'30d', '24h' or '1w' as a duration."""
    m = re.fullmatch(r"\s*(\d+)\s*([hdw])\s*", text.lower())
    if not m:
        raise ValueError(f"not a window: {text}")
    return timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])})


def select_baseline(snaps: DataFrame, as_of: Column | None = None, since: str | None = None, all_time: bool = False) -> DataFrame:
    """(snapshot_ts): the earliest time ever or in the trailing window, else the second newest; none raises."""
    times = snaps.select("snapshot_ts").distinct()
    if since is not None and all_time:
        raise ValueError("since and all_time exclude each other")
    if since is not None:
        times = times.where(F.col("snapshot_ts") >= (as_of if as_of is not None else F.current_timestamp()) - F.lit(parse_window(since)))
    if since is not None or all_time:
        out = times.agg(F.min("snapshot_ts").alias("snapshot_ts")).where("snapshot_ts is not null")
    else:
        out = times.orderBy(F.desc("snapshot_ts")).limit(2).agg(F.min("snapshot_ts").alias("snapshot_ts"), F.count("*").alias("n")).where("n = 2").select("snapshot_ts")
    if out.isEmpty():
        raise ValueError("no snapshot to compare with")
    return out


def diff_pair(snaps: DataFrame, between: tuple[date, date] | None = None, live: DataFrame | None = None, as_of: Column | None = None, since: str | None = None, all_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """(from, to): two days' closest snapshots, live rows against the newest, or a baseline against the newest."""
    if between is not None:
        if live is not None or since is not None or all_time:
            raise ValueError("between goes with no other choice")
        return tuple(_at(snaps, closest_snapshot(snaps, d)) for d in between)
    if live is not None:
        base = _at(snaps, select_baseline(snaps, as_of, since, all_time)) if since is not None or all_time else latest_snapshot(snaps)
        return base, live
    return _at(snaps, select_baseline(snaps, as_of, since, all_time)), latest_snapshot(snaps)


def added(frm: DataFrame, to: DataFrame) -> DataFrame:
    return to.join(frm, "title_id", "left_anti")


def removed(frm: DataFrame, to: DataFrame) -> DataFrame:
    return frm.join(to, "title_id", "left_anti")


def _first(df: DataFrame, ord: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("title_id").orderBy(ord))).where("__r = 1").drop("__r")


def changed(frm: DataFrame, to: DataFrame, ord: str = "title") -> DataFrame:
    """Titles on both sides (first row of each id) that differ in a compared column that both sides have."""
    names = [c for c in COMPARED if c in frm.columns and c in to.columns]
    a = _first(frm, ord).select("title_id", *(F.col(c).alias(f"from_{c}") for c in names))
    b = _first(to, ord).select("title_id", "title", *(F.col(c).alias(f"to_{c}") for c in names))
    differs = [~F.col(f"from_{c}").eqNullSafe(F.col(f"to_{c}")) for c in names]
    out = a.join(b, "title_id").where(reduce(lambda x, y: x | y, differs))
    delta = F.col("to_completion_percent") - F.col("from_completion_percent")
    version = ~F.col("from_latest_version").eqNullSafe(F.col("to_latest_version")) if "latest_version" in names else F.lit(False)
    return out.withColumns({"delta": half_even(delta), "version_changed": version})


def version_bumps(changes: DataFrame) -> DataFrame:
    return changes.where("version_changed")


def diff_summary(frm: DataFrame, to: DataFrame, ord: str = "title") -> DataFrame:
    """Counts of all rows, and of ids added, removed, changed and unchanged, with the mean delta, in one full join."""
    pick = lambda df, p: df.groupBy("title_id").agg(F.count("*").alias(f"{p}_n"), F.min_by(F.struct(*COMPARED), ord).alias(p))
    j = pick(frm, "f").join(pick(to, "t"), "title_id", "full_outer")
    both = F.col("f_n").isNotNull() & F.col("t_n").isNotNull()
    differs = both & reduce(lambda x, y: x | y, (~F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in COMPARED))
    delta = F.when(differs, half_even(F.col("t.completion_percent") - F.col("f.completion_percent")))
    return j.agg(
        F.coalesce(F.sum("f_n"), F.lit(0)).alias("from_rows"), F.coalesce(F.sum("t_n"), F.lit(0)).alias("to_rows"),
        F.coalesce(F.sum(F.when(F.col("f_n").isNull(), F.col("t_n"))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.when(F.col("t_n").isNull(), F.col("f_n"))), F.lit(0)).alias("removed"),
        F.count_if(differs).alias("changed"), F.count_if(both & ~differs).alias("unchanged"), mean_of_hundredths(delta).alias("avg_delta"),
        F.count_if(differs & ~F.col("f.latest_version").eqNullSafe(F.col("t.latest_version"))).alias("version_bumps"),
    )
