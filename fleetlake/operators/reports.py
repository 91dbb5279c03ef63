"""Report tables over titles, devices, changes and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, half_even, percent_text
from .titles import covered_by

#: Internal columns that reports leave out.
INTERNAL = ("sources", "title_id", "name_id")
#: Source tokens and their headings, in fixed order.
SOURCES = {"installomator": "Installomator", "homebrew_cask": "Homebrew", "autopkg": "AutoPkg", "jamf_app_installer": "Jamf App Installers"}


def fleet_summary(titles: DataFrame, threshold: float = 70.0) -> DataFrame:
    return titles.agg(
        F.count("*").alias("titles"), F.coalesce(half_even(F.avg("completion_percent")), F.lit(0.0)).alias("avg_completion"),
        F.count_if(F.col("completion_percent") < threshold).alias("below_threshold"), F.coalesce(F.sum("total_hosts"), F.lit(0)).alias("hosts"), F.coalesce(F.sum("hosts_patched"), F.lit(0)).alias("patched"),
    )


def health_band(c: Column, threshold: float = 70.0) -> Column:
    return F.when(c < threshold, "red").when(c < 90, "yellow").otherwise("green")


def daily_summary(titles: DataFrame) -> DataFrame:
    """(kind, title, value): tracked, at_least_90 and below_70 counts, and the worst five titles by completion."""
    counts = titles.agg(F.count("*").alias("tracked"), F.count_if(F.col("completion_percent") >= 90).alias("at_least_90"), F.count_if(F.col("completion_percent") < 70).alias("below_70"))
    counts = counts.unpivot([], ["tracked", "at_least_90", "below_70"], "kind", "value").select("kind", F.lit("").alias("title"), F.col("value").cast("double").alias("value"))
    worst = titles.orderBy("completion_percent", "title", "title_id").limit(5)
    return counts.union(worst.select(F.lit("worst"), "title", "completion_percent"))


def report_columns(titles: DataFrame) -> DataFrame:
    """Without internal columns, headings in Title Case."""
    df = titles.drop(*INTERNAL)
    return df.toDF(*(c.replace("_", " ").title() for c in df.columns))


def coverage_columns(titles: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """A Y/N column for each source token."""
    return titles.withColumns({SOURCES[t]: F.when(covered_by(t), "Y").otherwise("N") for t in tokens or SOURCES})


def device_detail(devices: DataFrame, titles: DataFrame) -> DataFrame:
    """Device rows with the name of their sheet: the title without : \\ / ? * [ ], at most 31 characters."""
    names = titles.select("title_id", "title")
    df = devices.join(names, "title_id", "left")
    sheet = F.substring(F.translate(F.coalesce("title", F.concat(F.lit("Title_"), "title_id")), ":\\/?*[]", ""), 1, 31)
    plain = {c: F.coalesce(c, F.lit("")) for c in ("building_name", "department_name", "site_name")}
    return df.withColumns(plain | {"sheet": sheet, "last_contact": F.date_format("last_contact_time", "yyyy-MM-dd HH:mm:ss")}).drop("title", "last_contact_time")


def write_device_sheets(detail: DataFrame, path: str, salts: int = 16) -> None:
    """One folder for each sheet; the rows of a title are dealt over ``salts`` tasks."""
    salt = F.pmod(F.xxhash64("device_id"), F.lit(salts))
    detail.repartition("sheet", salt).write.partitionBy("sheet").parquet(path)


def log_events(titles: DataFrame, as_of: Column, size: int = 1000) -> DataFrame:
    """(batch, message, ts, title_id, completion_percent): one event for each title, in batches of at most ``size``.

    Batches are dealt by position within ranges of titles, so no task sorts them all.
    """
    ranged = titles.repartitionByRange("title", "title_id").withColumn("p", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("p").orderBy("title", "title_id"))
    one = half_even("completion_percent", 1).cast("decimal(18,1)").cast("string")
    return ranged.withColumn("n", n).select(
        F.concat(F.col("p"), F.lit("-"), F.ceil(F.col("n") / size)).alias("batch"), F.concat("title", F.lit(" at "), one, F.lit("%")).alias("message"), as_of.alias("ts"), "title_id", "completion_percent"
    )


def diff_report(changes: DataFrame) -> DataFrame:
    """Text columns of changed titles."""
    arrow = lambda a, b: F.concat(a, F.lit(" → "), b)
    version = F.when(F.col("version_changed"), F.concat(arrow(F.coalesce("from_latest_version", F.lit("")), F.coalesce("to_latest_version", F.lit(""))), F.lit(" (bump)"))).otherwise(F.coalesce("to_latest_version", F.lit("")))
    hosts = arrow(F.col("from_total_hosts").cast("string"), F.col("to_total_hosts").cast("string"))
    return changes.select("title_id", "title", arrow(percent_text("from_completion_percent"), percent_text("to_completion_percent")).alias("completion"), hosts.alias("hosts"), version.alias("version"))


def analysis_table(titles: DataFrame, threshold: float = 70.0) -> DataFrame:
    return titles.select(
        "title", "released", "hosts_patched", "missing_patch", "total_hosts", "completion_percent",
        health_band(F.col("completion_percent"), threshold).alias("health"), F.when(covered_by("installomator"), "Y").otherwise("N").alias("label"),
    )


def drift_report(entries: DataFrame) -> DataFrame:
    """(slug, name, versions, leader): versions as 'source=version, …'; no leader shows as a dash."""
    shown = F.array_join(F.transform("versions", lambda v: F.concat(v["source"], F.lit("="), v["version"])), ", ")
    return entries.select("slug", "name", shown.alias("versions"), F.coalesce(blank_to_null("leader"), F.lit("—")).alias("leader"))
