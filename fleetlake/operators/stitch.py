"""Several upstream catalogs stitched into one app table, with fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_clean_url, is_shell_expression, normalize_name
from ..sources.storage import latest_by, left_join_spread

SOURCE_ORDER = ("installomator", "homebrew_cask", "autopkg", "jamf_app_installer")
#: Install methods.
INSTALL_METHODS = ("dmg", "pkg", "zip", "tbz", "pkgInDmg", "pkgInZip", "appInDmgInZip")
#: Reverse-DNS prefixes that are not a vendor.
TLDS = ("com", "org", "net", "io", "co", "us", "edu", "app")
#: Edition tokens dropped from the end of installer titles.
EDITIONS = ("dc", "continuous", "x", "pro", "enterprise", "standard", "lts", "ce", "beta", "unified", "classic", "legacy", "app", "edition", "plus", "mac", "macos")
#: Vendor names dropped from the front of installer titles.
VENDORS = (
    "adobe", "amazon", "apple", "atlassian", "cisco", "citrix", "dell", "extensis", "facebook", "google", "hp", "ibm", "iterate", "jamf",
    "jetbrains", "logmein", "microsoft", "mozilla", "openai", "oracle", "poly", "readcube", "root3", "sap", "techsmith", "vmware", "zoom",
)
#: Bundle ids of labels and casks that carry none.
CURATED_BUNDLES = {
    "aspera": "com.ibm.software.aspera.desktop", "bbedit": "com.barebones.bbedit", "charles": "com.xk72.Charles", "claudedesktop": "com.anthropic.claudefordesktop",
    "cursorai": "com.todesktop.230313mzl4w4u92", "dbeaverce": "org.jkiss.dbeaver.core.product", "docker": "com.docker.docker", "farrago": "com.rogueamoeba.farrago",
    "filemakerpro": "com.filemaker.client.pro12", "intellij-idea-ce": "com.jetbrains.intellij.ce", "kiro": "dev.kiro.desktop", "microsoftcompanyportal": "com.microsoft.CompanyPortalMac",
    "microsoftwindowsapp": "com.microsoft.rdc.macos", "musescore": "org.musescore.MuseScore", "nextcloud": "com.nextcloud.desktopclient", "obs": "com.obsproject.obs-studio",
    "pycharm-ce": "com.jetbrains.pycharm.ce", "realvncviewer": "com.realvnc.vncviewer", "sassafraskeyaccess": "com.sassafras.KeyAccess", "suspiciouspackage": "com.mothersruin.SuspiciousPackageApp",
    "teamviewer-host": "com.teamviewer.TeamViewerHost", "teamviewer-quickjoin": "com.teamviewer.TeamViewerQJ", "windsurf": "com.exafunction.windsurf", "zoom": "us.zoom.xos",
}


def cask_app_index(casks: DataFrame) -> DataFrame:
    """(app_name, token): each .app artifact's cask; the first by ord, then by place."""
    apps = casks.select("token", "ord", F.posexplode("artifacts").alias("p", "a")).select("token", "ord", "p", F.get("a.app", 0).alias("app_name"))
    w = Window.partitionBy("app_name").orderBy("ord", "p")
    return apps.where("app_name is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("app_name", "token")


def match_casks(labels: DataFrame, casks: DataFrame) -> DataFrame:
    """(name, token): the cask whose token is the label's name, else that which installs '<display name>.app'."""
    direct = casks.select(F.col("token").alias("name"), F.col("token").alias("by_token"))
    shown = labels.select("name", F.concat(F.coalesce(blank_to_null("display_name"), "name"), F.lit(".app")).alias("app_name"))
    hit = shown.join(direct, "name", "left").join(cask_app_index(casks).withColumnRenamed("token", "by_app"), "app_name", "left")
    return hit.select("name", F.coalesce("by_token", "by_app").alias("token")).where("token is not null")


def recipes_by_name(recipes: DataFrame) -> DataFrame:
    """(key, recipes): recipes of each normalised name, in order of their identifiers; aggregated before any join."""
    url = F.concat(F.lit("https://github.com/"), "repo", F.lit("/blob/master/"), "path")
    cols = ("identifier", "name", "repo", "path", "inferred_type")
    df = recipes.select(normalize_name("name").alias("key"), F.struct(*cols, url.alias("recipe_url")).alias("r")).where("key <> ''")
    return df.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("recipes"))


def installer_keys(title: Column) -> Column:
    """Array of struct(key, tier, pos): the exact normalised title, then without trailing versions and editions, then without a known vendor."""
    exact = normalize_name(title)
    back = F.reverse(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), 0))
    # from the end: drop while a token is decoration, keep all from the first that is not
    kept = F.aggregate(back, F.array().cast("array<string>"), lambda acc, t: F.when((F.size(acc) == 0) & (t.rlike(r"^v?\d+$") | t.isin(*EDITIONS)), acc).otherwise(F.concat(acc, F.array(t))))
    tokens = F.reverse(kept)
    short = F.array_join(tokens, "")
    bare = F.when(F.get(tokens, 0).isin(*VENDORS), F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), "")).otherwise("")
    keys = F.array_distinct(F.filter(F.array(exact, short, bare), lambda k: k != ""))
    return F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.when(k == exact, 0).otherwise(1).alias("tier"), i.alias("pos")))


def installers_by_key(installers: DataFrame) -> DataFrame:
    """(key, title): the installer of each key; exact keys first, then by ord and place."""
    df = installers.select("title", "ord", F.explode(installer_keys(F.col("title"))).alias("k")).select("title", "ord", "k.*")
    w = Window.partitionBy("key").orderBy("tier", "ord", "pos")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "title")


def match_installer(side: DataFrame, installers: DataFrame) -> DataFrame:
    """(slug, title) for (slug, bundle, key): the installer of that bundle id (the last by ord), else of that key."""
    bundles = latest_by(installers.where("bundle_id is not null and bundle_id <> ''"), ["bundle_id"], "ord").select(F.col("bundle_id").alias("bundle"), F.col("title").alias("by_bundle"))
    keys = installers_by_key(installers).withColumnRenamed("title", "by_key")
    hit = left_join_spread(left_join_spread(side, bundles, "bundle", "slug"), keys, "key", "slug")
    return hit.select("slug", F.coalesce("by_bundle", "by_key").alias("title")).where("title is not null")


def own_bundle_id(package_id: Column, name: Column) -> Column:
    """A label's package id, else the curated id of its name or token."""
    curated = F.create_map(*(F.lit(x) for kv in CURATED_BUNDLES.items() for x in kv))
    return F.coalesce(blank_to_null(package_id), F.try_element_at(curated, name))


def backfill_bundle_id(own: Column, installer: Column) -> Column:
    return F.coalesce(blank_to_null(own), blank_to_null(installer))


def extract_vendor(package_id: Column, display_name: Column) -> Column:
    """The reverse-DNS segment after a known prefix (or the first), capitalised; else the first word of the name."""
    parts = F.split(package_id, r"\.")
    segment = F.when(F.lower(F.get(parts, 0)).isin(*TLDS), F.get(parts, 1)).otherwise(F.get(parts, 0))
    dotted = F.concat(F.upper(F.substring(segment, 1, 1)), F.substr(segment, F.lit(2)))
    return F.when(package_id.contains("."), dotted).otherwise(blank_to_null(F.get(F.split(F.trim(display_name), r"\s+"), 0)))


def resolve_version(label: Column, cask: Column, installer: Column) -> Column:
    return F.coalesce(F.when(~is_shell_expression(label), blank_to_null(label)), blank_to_null(cask), blank_to_null(installer))


def clean_url(url: Column) -> Column:
    return F.when(is_clean_url(url), url)


def resolve_download_url(label: Column, cask: Column, installer: Column, installer_source: Column) -> Column:
    """The first clean one of: a literal label url, the cask's, an External installer's."""
    return F.coalesce(F.when(~is_shell_expression(label), clean_url(label)), clean_url(cask), F.when(installer_source == "External", clean_url(installer)))


def resolve_install_method(kind: Column) -> Column:
    return F.when(kind.isin(*INSTALL_METHODS), kind)


def infer_install_method(url: Column) -> Column:
    """By the suffix of a cask's url."""
    low = F.lower(url)
    return F.when(low.endswith(".dmg"), "dmg").when(low.endswith(".pkg"), "pkg").when(low.endswith(".zip"), "zip").when(low.endswith(".tbz") | low.endswith(".tar.bz2"), "tbz")


def canonical_sources(**present: Column) -> Column:
    """The sources that are present, in fixed order."""
    return F.array_compact(F.array(*(F.when(present[s], s) for s in SOURCE_ORDER if s in present)))


LABEL_DETAIL = "struct<label_name:string,label_url:string,raw:map<string,array<string>>>"


def _payloads(df: DataFrame, casks: DataFrame, recipes: DataFrame, installers: DataFrame) -> DataFrame:
    """Cask, recipe and installer details for (token, key, slug, bundle, …)."""
    cask = casks.select("token", F.struct("token", "name", "url", "version", "sha256").alias("cask_detail"))
    inst = installers.select(F.col("title").alias("i_title"), F.struct("title", "source", "bundle_id", "version", "jamf_id", "download_url").alias("installer_detail"))
    inst = inst.groupBy("i_title").agg(F.first("installer_detail").alias("installer_detail"))
    df = df.withColumn("key", F.nullif("key", F.lit("")))  # no feed has an empty key
    matched = match_installer(df.select("slug", "bundle", "key"), installers).withColumnRenamed("title", "i_title")
    out = left_join_spread(df, cask, "token", "slug").join(matched, "slug", "left")
    out = left_join_spread(out, inst, "i_title", "slug")
    # last, as its lists of recipes are most of a row: no later join shuffles and sorts them
    lists = recipes_by_name(recipes).withColumnRenamed("recipes", "__recipes").withColumn("__has_recipes", F.lit(True))
    out = left_join_spread(out, lists, "key", "slug")
    # the mark tells whether a list was met: for queries that ask no more, Spark leaves the lists and the DISTINCT of recipes out of the plan
    return out.withColumn("recipe_detail", F.when(F.col("__has_recipes"), F.coalesce("__recipes", F.array()))).drop("__recipes")


_APP = ("slug", "bundle_id", "name", "vendor", "current_version", "download_url", "install_method", "expected_team_id", "sha256", "sources", "label_detail", "cask_detail", "recipe_detail", "installer_detail")


def label_apps(labels: DataFrame, casks: DataFrame, recipes: DataFrame, installers: DataFrame) -> DataFrame:
    """One app for each label, its slug the label's name."""
    shown = F.coalesce(blank_to_null("display_name"), "name")
    raw_cols = {"name": "display_name", "type": "install_type", "downloadURL": "download_url", "appNewVersion": "app_new_version", "expectedTeamID": "expected_team_id"}
    raw = F.col("raw") if "raw" in labels.columns else F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.array(v).alias("v")) for k, v in raw_cols.items())), lambda x: F.get(x["v"], 0).isNotNull()))
    df = labels.join(match_casks(labels, casks), "name", "left").select(
        F.col("name").alias("slug"), shown.alias("name"), normalize_name(shown).alias("key"), own_bundle_id(F.col("package_id"), F.col("name")).alias("bundle"), "token",
        extract_vendor(F.col("package_id"), F.col("display_name")).alias("vendor"), F.col("app_new_version"), F.col("download_url").alias("l_url"), F.col("install_type"), "expected_team_id",
        F.struct(F.col("name").alias("label_name"), F.concat(F.lit("fragments/labels/"), "name", F.lit(".sh")).alias("label_url"), raw.alias("raw")).alias("label_detail"),
    )
    df = _payloads(df, casks, recipes, installers)
    c, i = F.col("cask_detail"), F.col("installer_detail")
    return df.withColumns(
        {
            "bundle_id": backfill_bundle_id(F.col("bundle"), i["bundle_id"]),
            "current_version": resolve_version(F.col("app_new_version"), c["version"], i["version"]),
            "download_url": resolve_download_url(F.col("l_url"), c["url"], i["download_url"], i["source"]),
            "install_method": resolve_install_method(F.col("install_type")),
            "sha256": c["sha256"],
            "sources": canonical_sources(installomator=F.lit(True), homebrew_cask=c.isNotNull(), autopkg=F.col("__has_recipes").isNotNull(), jamf_app_installer=i.isNotNull()),
        }
    ).select(*_APP)


def cask_only_apps(labels: DataFrame, casks: DataFrame, recipes: DataFrame, installers: DataFrame) -> DataFrame:
    """One app for each cask that no label claims, its slug the token."""
    free = casks.join(match_casks(labels, casks).select("token").distinct(), "token", "left_anti")
    shown = F.coalesce(blank_to_null("name"), "token")
    df = free.select(F.col("token").alias("slug"), shown.alias("name"), normalize_name(shown).alias("key"), own_bundle_id(F.lit(None).cast("string"), F.col("token")).alias("bundle"), "token")
    df = _payloads(df, casks, recipes, installers)
    c, i = F.col("cask_detail"), F.col("installer_detail")
    none = F.lit(None)
    return df.withColumns(
        {
            "bundle_id": backfill_bundle_id(F.col("bundle"), i["bundle_id"]),
            "vendor": F.get(F.split(F.trim("name"), r"\s+"), 0),
            "current_version": F.coalesce(blank_to_null(c["version"]), blank_to_null(i["version"])),
            "download_url": F.coalesce(clean_url(c["url"]), F.when(i["source"] == "External", clean_url(i["download_url"]))),
            "install_method": infer_install_method(c["url"]),
            "expected_team_id": none.cast("string"),
            "sha256": c["sha256"],
            "sources": canonical_sources(homebrew_cask=F.lit(True), autopkg=F.col("__has_recipes").isNotNull(), jamf_app_installer=i.isNotNull()),
            "label_detail": none.cast(LABEL_DETAIL),
        }
    ).select(*_APP)


def stitch_catalog(labels: DataFrame, casks: DataFrame, recipes: DataFrame, installers: DataFrame) -> DataFrame:
    """All apps: those of labels, then casks of their own; recipes and installers only attach."""
    return label_apps(labels, casks, recipes, installers).unionByName(cask_only_apps(labels, casks, recipes, installers))


def stitch_counts(apps: DataFrame) -> DataFrame:
    has = lambda s: F.array_contains("sources", s)
    return apps.agg(
        F.count_if(has("installomator")).alias("installomator"), F.count_if(~has("installomator")).alias("cask_only"), F.count_if(has("installomator") & has("homebrew_cask")).alias("both"),
        F.count_if(has("autopkg")).alias("autopkg_attached"), F.count_if(has("jamf_app_installer")).alias("installer_attached"), F.count("*").alias("total"),
    )
