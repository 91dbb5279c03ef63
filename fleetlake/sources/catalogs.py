"""Catalog feeds: casks, recipes, installers, patch titles, label trees, resolved values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.helpers import html_unescape
from ..functions.text import blank_to_null, is_clean_url, is_clean_version

_CASK = "token string, name array<string>, desc string, homepage string, url string, version string, sha256 string, auto_updates boolean, artifacts array<struct<app:array<string>>>"


def ingest_casks(raw: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(casks, counts) from ``raw`` (ord, record as JSON text).

    A record needs a token and a name array; its name is the first one, else the token. Of records
    with one token the last counts. counts: ingested, skipped.
    """
    j = F.from_json("record", _CASK)
    df = raw.select("ord", "record", j.alias("j"), F.get_json_object("record", "$.name").alias("name_text"))
    ok = F.col("j.token").isNotNull() & (F.col("j.token") != "") & F.coalesce(F.col("name_text").startswith("["), F.lit(False)) & F.col("j.name").isNotNull()
    df = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    counts = df.agg(F.count_if("ok").alias("ingested"), F.count_if(~F.col("ok")).alias("skipped"))
    keep = df.where("ok").select("ord", F.col("j.token").alias("token"), F.coalesce(F.get("j.name", 0), "j.token").alias("name"), "j.desc", "j.homepage", "j.url", "j.version", "j.sha256", "j.auto_updates", "j.artifacts", F.col("record").alias("raw"), as_of.alias("ingested_at"))
    cols = [c for c in keep.columns if c != "token"]
    last = keep.groupBy("token").agg(F.max_by(F.struct(*cols), "ord").alias("r"))
    return last.select("token", "r.*"), counts


_RECIPE = "name string, description string, repo string, path string, parent string, shortname string, inferred_type string"


def recipe_entries(index: DataFrame) -> DataFrame:
    """(identifier, entry, reason) of an index (identifiers: map of JSON text); reason is null for good entries."""
    df = index.select(F.explode("identifiers").alias("identifier", "entry")).withColumn("j", F.from_json("entry", _RECIPE))
    reason = (
        F.when(F.col("entry").isNull() | ~F.trim("entry").startswith("{"), "not an object")
        .when(blank_to_null("j.repo").isNull(), "missing repo")
        .when(blank_to_null("j.path").isNull(), "missing path")
    )
    return df.withColumn("reason", reason)


def ingest_recipes(index: DataFrame, as_of: Column) -> DataFrame:
    """Recipe rows keyed by identifier."""
    j = [F.col(f"j.{c}") for c in ("name", "shortname", "repo", "path")]
    return recipe_entries(index).where("reason is null").select("identifier", *j, F.col("j.parent").alias("parent_identifier"), "j.inferred_type", "j.description", F.col("entry").alias("raw"), as_of.alias("ingested_at"))


def recipe_skip_reasons(entries: DataFrame, examples: int = 3) -> DataFrame:
    """(reason, n, examples): skipped entries by reason, most common first, with their smallest identifiers."""
    from pyspark.sql import Window

    bad = entries.where("reason is not null")
    first = bad.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("identifier"))).where(F.col("r") <= examples)
    named = first.groupBy("reason").agg(F.array_sort(F.collect_list("identifier")).alias("examples"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).join(named, "reason").orderBy(F.desc("n"), "reason")


def ingest_installers(titles: DataFrame) -> DataFrame:
    """Installer rows from title payloads; source 'Jamf' only for media from the vendor's own server, else 'External'."""
    url = blank_to_null(F.get("media_sources", 0)["url"])
    source = F.when(F.upper("media_source_type") == "JAMF_SERVER", "Jamf").otherwise("External")
    return titles.select(
        "ord", F.col("title_name").alias("title"), source.alias("source"),
        F.when(source == "External", blank_to_null(F.lower(F.try_parse_url(url, F.lit("HOST"))))).alias("host"),
        blank_to_null("bundle_id").alias("bundle_id"), F.coalesce(blank_to_null("version"), blank_to_null("short_version")).alias("version"),
        F.col("id").alias("jamf_id"), url.alias("download_url"), blank_to_null("architecture").alias("architecture"),
    )


def read_catalog_titles(spark: SparkSession, path: str) -> DataFrame:
    """Patch-title catalog rows from XML; all ids are text."""
    schema = "name_id string, app_name string, publisher string, current_version string, last_modified string"
    df = spark.read.format("xml").option("rowTag", "available_title").schema(schema).load(path)
    return df.withColumn("last_modified", F.try_to_timestamp("last_modified"))


def tree_to_labels(tree: DataFrame) -> DataFrame:
    """(name, sha) of the label blobs of a repository tree (path, type, sha)."""
    name = F.lower(F.regexp_extract("path", r"^fragments/labels/([^/]+)\.sh$", 1))
    return tree.where((F.col("type") == "blob") & F.col("path").rlike(r"^fragments/labels/[^/]+\.sh$")).select(name.alias("name"), "sha")


def sha_gate(upstream: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(name, state): changed (new, other sha, or forced), unchanged, or removed (only in existing)."""
    both = upstream.select("name", F.col("sha").alias("new")).join(existing.select("name", F.col("blob_sha").alias("old")), "name", "full_outer")
    return both.select("name", F.when(F.col("new").isNull(), "removed").when(F.lit(force) | ~F.col("new").eqNullSafe(F.col("old")), "changed").otherwise("unchanged").alias("state"))


def label_names(lines: DataFrame) -> DataFrame:
    """Distinct lower-cased names of a label list (column ``line``); blank lines and comments go."""
    name = F.lower(F.trim("line"))
    return lines.select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#")).distinct()


def merge_resolved(labels: DataFrame, records: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(labels, summary): resolved values put into the labels that exist.

    ``records`` has ord, label, ok, downloadURL and appNewVersion (each null, text, or JSON text of an
    array, whose first element counts). Entities are decoded; a url or version that is not clean is
    invalid; for each field the last valid value by ord wins, and stamps the label as resolved. The
    summary counts records: received, malformed (no label), not_ok, unknown (no such label), invalid (a
    field that is not clean), updated (at least one valid field).
    """
    scalar = lambda c: F.when(F.col(c).startswith("["), F.get(F.from_json(c, "array<string>"), 0)).otherwise(F.col(c))
    df = records.select("ord", "label", F.coalesce("ok", F.lit(False)).alias("ok"), html_unescape(scalar("downloadURL")).alias("url"), html_unescape(scalar("appNewVersion")).alias("version"))
    df = df.withColumns({"good_url": is_clean_url("url"), "good_version": is_clean_version("version"), "named": blank_to_null("label").isNotNull()})
    names = labels.select(F.col("name").alias("label"), F.lit(True).alias("known"))
    df = df.join(names, "label", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    live = F.col("named") & F.col("ok") & F.col("known")
    invalid = (F.col("url").isNotNull() & ~F.col("good_url")) | (F.col("version").isNotNull() & ~F.col("good_version"))
    summary = df.agg(
        F.count("*").alias("received"), F.count_if(~F.col("named")).alias("malformed"), F.count_if(F.col("named") & ~F.col("ok")).alias("not_ok"),
        F.count_if(F.col("named") & F.col("ok") & ~F.col("known")).alias("unknown"), F.count_if(live & invalid).alias("invalid"), F.count_if(live & (F.col("good_url") | F.col("good_version"))).alias("updated"),
    )
    last = df.where(live & (F.col("good_url") | F.col("good_version"))).groupBy(F.col("label").alias("name")).agg(
        F.max_by("url", F.when(F.col("good_url"), F.col("ord"))).alias("new_url"), F.max_by("version", F.when(F.col("good_version"), F.col("ord"))).alias("new_version")
    )
    out = labels.join(last, "name", "left")
    hit = F.col("new_url").isNotNull() | F.col("new_version").isNotNull()
    values = {
        "download_url": F.coalesce("new_url", "download_url"), "app_new_version": F.coalesce("new_version", "app_new_version"),
        "resolution_source": F.when(hit, "macos").otherwise(F.col("resolution_source") if "resolution_source" in labels.columns else F.lit(None).cast("string")),
        "resolved_at": F.when(hit, as_of).otherwise(F.col("resolved_at") if "resolved_at" in labels.columns else F.lit(None).cast("timestamp")),
    }
    return out.withColumns(values).drop("new_url", "new_version"), summary
