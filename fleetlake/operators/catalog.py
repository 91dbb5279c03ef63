"""Questions to the app catalog: pages, search, coverage, codes, version drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_scalar, normalize_name
from ..functions.versions import parse_version
from .stitch import INSTALL_METHODS

DETAILS = {"installomator": "label_detail", "homebrew_cask": "cask_detail", "autopkg": "recipe_detail", "jamf_app_installer": "installer_detail"}


def list_apps(apps: DataFrame, vendor: str | None = None, source: str | None = None, exclude_source: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in slug order; the vendor is an ilike pattern, limit is 1 to 1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    if vendor is not None:
        apps = apps.where(F.col("vendor").ilike(vendor))
    if source is not None:
        apps = apps.where(F.array_contains("sources", source))
    if exclude_source is not None:
        apps = apps.where(~F.array_contains("sources", exclude_source))
    return apps.orderBy("slug").offset(offset).limit(limit)


def search_apps(apps: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Apps whose slug, name, vendor or bundle id holds the text in any case, in slug order."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in ("slug", "name", "vendor", "bundle_id")))
    return apps.where(hit).orderBy("slug").limit(max(1, min(limit, 100)))


def get_app(apps: DataFrame, slug: str) -> DataFrame:
    """The app of a slug; an unknown one raises."""
    out = apps.where(F.col("slug") == slug)
    if out.isEmpty():
        raise KeyError(slug)
    return out


def get_app_sources(apps: DataFrame, slugs: DataFrame) -> DataFrame:
    """(slug and the four details) for a table of slugs."""
    return slugs.select("slug").join(apps.select("slug", *DETAILS.values()), "slug")


def catalog_summary(apps: DataFrame) -> DataFrame:
    """The number of apps, and of those with a detail from each source."""
    return apps.agg(F.count("*").alias("total"), *(F.count_if(F.col(d).isNotNull()).alias(s) for s, d in DETAILS.items()))


def catalog_last_refresh(*sources: DataFrame) -> DataFrame:
    newest = [s.agg(F.max("ingested_at").alias("at")) for s in sources]
    return reduce(DataFrame.union, newest).agg(F.max("at").alias("last_refresh"))


def catalog_last_mutation(labels: DataFrame, *sources: DataFrame) -> DataFrame:
    resolved = labels.agg(F.max("resolved_at").alias("at"))
    return catalog_last_refresh(labels, *sources).select(F.col("last_refresh").alias("at")).union(resolved).agg(F.max("at").alias("last_mutation"))


def catalog_categories(apps: DataFrame) -> DataFrame:
    """One row: sorted distinct sources and vendors, and the install methods."""
    sources = apps.select(F.explode("sources").alias("s")).distinct().agg(F.array_sort(F.collect_list("s")).alias("sources"))
    vendors = apps.where("vendor is not null").select("vendor").distinct().agg(F.array_sort(F.collect_list("vendor")).alias("vendors"))
    return sources.join(F.broadcast(vendors)).withColumn("install_methods", F.array(*map(F.lit, INSTALL_METHODS)))  # one row each


def recent_changes(apps: DataFrame, limit: int = 25) -> DataFrame:
    """The newest apps by id."""
    return apps.orderBy(F.desc("id")).limit(max(1, min(limit, 100)))


def code_index(apps: DataFrame, catalog_titles: DataFrame) -> DataFrame:
    """(code, slugs): slugs of each installer code and of each catalog title with the app's normalised name."""
    own = apps.select(F.col("installer_detail.jamf_id").alias("code"), "slug").where("code is not null and code <> ''")
    named = apps.select(normalize_name("name").alias("key"), "slug").join(catalog_titles.select(normalize_name("app_name").alias("key"), F.col("name_id").alias("code")), "key").select("code", "slug")
    return own.union(named).distinct().groupBy("code").agg(F.array_sort(F.collect_list("slug")).alias("slugs"))


def extract_versions(apps: DataFrame) -> DataFrame:
    """``apps`` (slug, name, vendor) with versions: array of struct(source, version) of the label's and cask's literal versions."""
    raw = F.try_element_at("label_detail.raw", F.lit("appNewVersion"))
    label = F.when(F.size(raw) == 1, F.trim(first_scalar(raw)))
    label = F.when((label != "") & ~label.rlike(r"[$|`]"), label)
    cask = F.trim(F.col("cask_detail.version"))
    cask = F.when((cask != "") & (cask != "latest"), cask)
    one = lambda s, v: F.when(v.isNotNull(), F.struct(F.lit(s).alias("source"), v.alias("version")))
    return apps.select("slug", "name", "vendor", F.array_compact(F.array(one("installomator", label), one("homebrew_cask", cask))).alias("versions"))


def drift_entries(apps: DataFrame) -> DataFrame:
    """Apps with two versioned sources: versions with parsed_ok, ``drifts``, leader and laggard.

    Two parsed versions are compared by their order, two unparsed ones as text in any case; one of each
    is drift. Leader and laggard are null unless both parse.
    """
    df = extract_versions(apps).where(F.size("versions") >= 2)
    a, b = F.get("versions", 0), F.get("versions", 1)
    df = df.withColumns({"ka": parse_version(a["version"]), "kb": parse_version(b["version"])})
    both, none = F.col("ka").isNotNull() & F.col("kb").isNotNull(), F.col("ka").isNull() & F.col("kb").isNull()
    drifts = F.when(both, F.col("ka") != F.col("kb")).when(none, F.lower(a["version"]) != F.lower(b["version"])).otherwise(True)
    order = lambda x, y: F.when(both & (F.col("ka") > F.col("kb")), x).when(both & (F.col("ka") < F.col("kb")), y)
    mark = lambda v, k: F.struct(v["source"].alias("source"), v["version"].alias("version"), F.col(k).isNotNull().alias("parsed_ok"))
    return df.select("slug", "name", "vendor", F.array(mark(a, "ka"), mark(b, "kb")).alias("versions"), drifts.alias("drifts"), order(a["source"], b["source"]).alias("leader"), order(b["source"], a["source"]).alias("laggard"))


def detect_drift(apps: DataFrame) -> DataFrame:
    return drift_entries(apps).where("drifts").drop("drifts")


def scan_drift(apps: DataFrame, vendor: str | None = None, source: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, totals): drifting apps in slug order, and how many were scanned and drift (after the source filter)."""
    if vendor is not None:
        apps = apps.where(F.col("vendor").ilike(vendor))
    entries = drift_entries(apps)
    wanted: Column = F.col("drifts")
    if source is not None:
        wanted = wanted & F.exists("versions", lambda v: v["source"] == source)
    totals = entries.agg(F.count("*").alias("total_scanned"), F.count_if(wanted).alias("total_with_drift"))
    return entries.where(wanted).drop("drifts").orderBy("slug").offset(offset).limit(limit), totals


def app_drift(apps: DataFrame, slug: str) -> DataFrame:
    return detect_drift(apps.where(F.col("slug") == slug))
