"""Title rows: projection from server payloads, derived metrics, hydration with error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, half_even
from .snapshots import normalize_columns
from .storage import numbered

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$"


def titles_from_summaries(df: DataFrame) -> DataFrame:
    """Title rows from summary payload columns; rows that are wholly null go."""
    df = df.where(F.coalesce(*(F.col(c).cast("string") for c in ("title", "softwareTitleId", "latestVersion"))).isNotNull())
    return df.select(
        F.col("title"), F.col("softwareTitleId").cast("string").alias("title_id"), F.col("releaseDate").alias("released"),
        F.col("upToDate").cast("long").alias("hosts_patched"), F.col("outOfDate").cast("long").alias("missing_patch"), F.col("latestVersion").alias("latest_version"),
    )


def derive_title_metrics(df: DataFrame) -> DataFrame:
    """total_hosts, completion_percent (half-even, 0 without hosts), title_id as text, ISO release times as their own local date."""
    total = F.col("hosts_patched") + F.col("missing_patch")
    shown = F.date_format(F.try_to_timestamp(F.substring("released", 1, 10), F.lit("yyyy-MM-dd")), "MMM dd yyyy")
    return df.withColumns(
        {
            "title_id": F.col("title_id").cast("string"),
            "released": F.when(F.col("released").rlike(_ISO), F.coalesce(shown, F.col("released"))).otherwise(F.col("released")),
            "total_hosts": total.cast("long"),
            "completion_percent": F.when(total > 0, half_even(F.col("hosts_patched") * 100.0 / total)).otherwise(0.0),
        }
    )


def attach_name_id(titles: DataFrame, configs: DataFrame) -> DataFrame:
    """``name_id`` by title id from configurations (softwareTitleId, softwareTitleNameId, ord); the last one counts."""
    last = configs.groupBy(F.col("softwareTitleId").cast("string").alias("title_id")).agg(F.max_by("softwareTitleNameId", "ord").alias("name_id"))
    return titles.drop("name_id").join(last, "title_id", "left")


_NEEDED = {"title": "string", "title_id": "string", "released": "string", "hosts_patched": "long", "missing_patch": "long", "latest_version": "string"}


def hydrate_titles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): typed title rows with metrics, and rows with an ``errors`` array that says what is wrong.

    Columns are normalised; ``sources`` JSON becomes a map; a missing or ill-typed required field is an error.
    """
    df = normalize_columns(df)
    for name in _NEEDED:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    typed = {n: F.col(n).try_cast(t) if t == "long" else F.col(n).cast("string") for n, t in _NEEDED.items()}
    checks = [F.when(typed[n].isNull(), F.concat(F.lit(f"{n}: "), F.when(F.col(n).isNull(), "missing").otherwise(f"not a {_NEEDED[n]}"))) for n in _NEEDED]
    df = df.withColumn("errors", F.array_compact(F.array(*checks)))
    bad = df.where(F.size("errors") > 0)
    good = df.where(F.size("errors") == 0).drop("errors").withColumns(typed)
    if dict(good.dtypes).get("sources") == "string":
        good = good.withColumn("sources", F.coalesce(F.from_json("sources", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>")))
    return derive_title_metrics(good), bad


def hydrate_report(df: DataFrame, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """An exported report (all strings, in the order of ``ord``) back to titles; missing title ids count up from 0."""
    df = normalize_columns(df)
    df = df.select(*(F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("NaN")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    if "title_id" not in df.columns:
        df = numbered(df, ord, "title_id").withColumn("title_id", F.col("title_id").cast("string"))
    return hydrate_titles(df.drop("completion_percent", "total_hosts"))


_DEVICE = {"computerName": "computer_name", "deviceId": "device_id", "username": "username", "operatingSystemVersion": "operating_system_version", "lastContactTime": "last_contact_time", "buildingName": "building_name", "departmentName": "department_name", "siteName": "site_name", "version": "version"}
_REQUIRED = ("computer_name", "device_id", "username", "operating_system_version", "last_contact_time", "version")


def device_rows(df: DataFrame) -> DataFrame:
    """Device rows from report columns: empty organisation fields become null, rows that fail validation go."""
    df = df.select("title_id", *(F.col(a).cast("string").alias(b) for a, b in _DEVICE.items()))
    df = df.withColumns({c: blank_to_null(c) for c in ("building_name", "department_name", "site_name")} | {"last_contact_time": F.try_to_timestamp("last_contact_time")})
    return df.where(" and ".join(f"{c} is not null" for c in _REQUIRED))


def write_device_reports(df: DataFrame, path: str) -> None:
    """Device reports as CSV files, a folder title_id=<id> for each title, by tasks of Spark's advisory size: each sorts its own part by title."""
    df.hint("rebalance", "title_id").write.partitionBy("title_id").option("header", "true").csv(path)


def read_device_reports(spark: SparkSession, path: str) -> DataFrame:
    """Device CSV files, one folder title_id=<id> for each title, as validated device rows."""
    schema = ", ".join(f"{c} string" for c in _DEVICE) + ", title_id string"
    return device_rows(spark.read.schema(schema).option("header", "true").csv(path))


def app_names_from_definitions(df: DataFrame) -> DataFrame:
    """(title_id, app_names): the non-blank killApps names of each title's first result."""
    names = F.transform(F.get("results", 0)["killApps"], lambda k: k["appName"])
    return df.select("title_id", F.coalesce(F.filter(names, lambda n: F.trim(n) != ""), F.array().cast("array<string>")).alias("app_names"))


def titles_envelope(titles: DataFrame, report_title: str, as_of) -> DataFrame:
    """One row: generated_at, report_title, title_count and all titles as JSON; for many titles use write_titles_ndjson."""
    cols = sorted(titles.columns)
    agg = titles.agg(F.count("*").alias("title_count"), F.to_json(F.array_sort(F.collect_list(F.struct("title_id", *(c for c in cols if c != "title_id"))))).alias("titles"))
    return agg.select(as_of.alias("generated_at"), F.lit(report_title).alias("report_title"), "title_count", "titles")


def write_titles_ndjson(titles: DataFrame, path: str) -> None:
    """Titles as lines of JSON, written in parallel."""
    titles.write.json(path)


def write_titles_envelope(titles: DataFrame, report_title: str, as_of: Column, path: str) -> int:
    """The document of ``titles_envelope`` as text files whose lines, in order of the files' names, join up to it; returns the title count.

    Titles go by ranges of title_id to as many files as Spark makes of them; a title's number, and with it
    where a comma stands, follows from the counts of the ranges before it. Repeated ids stand side by side;
    without titles the list is empty.
    """
    cols = ["title_id", *sorted(c for c in titles.columns if c != "title_id")]
    rows = numbered(titles.select("title_id", F.to_json(F.struct(*cols)).alias("text")), "title_id", "at")
    n = rows.count()
    lines = rows.select((F.col("at") + 1).alias("at"), F.concat(F.when(F.col("at") > 0, ",").otherwise(""), "text").alias("value"))
    head = F.to_json(F.struct(as_of.alias("generated_at"), F.lit(report_title).alias("report_title"), F.lit(n).alias("title_count")))
    ends = titles.sparkSession.range(2).withColumn("head", head).select((F.col("id") * (n + 1)).alias("at"), F.when(F.col("id") == 0, F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"titles":['))).otherwise(F.lit("]}")).alias("value"))
    lines.union(ends).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    return n
