"""Label rows: projection of parsed fragments, validation, worklists, generated labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import parse_fragment_batches
from ..functions.text import blank_to_null, classify_value, first_scalar, is_clean_url, is_clean_version, is_shell_expression, shell_quote

#: Team ids whose labels are left out.
EXCLUDED_TEAMS = ("Frydendal", "Media", "LL3KBL2M3A", "TDTHCUPYFR")
#: Labels that are never resolved.
EXCLUDED_LABELS = (
    "skype", "workplacechat", "salesforcesfdx", "microsoftazuredatastudio", "teamviewerhostcustom", "teamviewerqscustom", "examplify",
    "steinbergcubaseelementsaile13", "steinbergcubaseproartist13", "toonboomharmony2024", "sketchupviewer", "nditools", "lsagent", "appsanywhere",
    "editshare-connect", "editshare-flowstory", "surfdrive", "outputhub", "realvnconedemandassist",
)
#: Label types.
LABEL_TYPES = ("dmg", "pkg", "zip", "tbz", "pkgInDmg", "pkgInZip", "appInDmgInZip", "appindmg", "bz2")
URL_TYPES = {".dmg": "dmg", ".pkg": "pkg", ".zip": "zip", ".tbz": "tbz", ".tar.bz2": "tbz"}


def parse_fragments(df: DataFrame) -> DataFrame:
    """(name, key, pos, value, is_array) of every assignment in (name, fragment); no shuffle."""
    return df.select("name", "fragment").mapInPandas(parse_fragment_batches, "name string, key string, pos int, value array<string>, is_array boolean")


def ingest_labels(parsed: DataFrame, as_of: Column) -> DataFrame:
    """One row for each label with assignments and no excluded team: first values, shell expressions and values that are not clean as null."""
    keys = {"name": "display_name", "type": "install_type", "packageID": "package_id", "downloadURL": "download_url", "appNewVersion": "app_new_version", "expectedTeamID": "expected_team_id"}
    first = parsed.where("pos = 0").groupBy("name").agg(
        *(F.max(F.when(F.col("key") == k, first_scalar("value"))).alias(v) for k, v in keys.items()), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("raw")
    )
    df = first.where(~F.coalesce(F.col("expected_team_id").isin(*EXCLUDED_TEAMS), F.lit(False)))
    literal = lambda c: F.when(~is_shell_expression(c), F.col(c))
    df = df.withColumns({c: literal(c) for c in keys.values()})
    return df.withColumns({"download_url": F.when(is_clean_url("download_url"), F.col("download_url")), "app_new_version": F.when(is_clean_version("app_new_version"), F.col("app_new_version")), "ingested_at": as_of})


def classified(labels: DataFrame) -> DataFrame:
    """(name, kind, status, reason) of both resolvable fields of every label."""
    parts = [labels.select("name", F.lit(k).alias("kind"), classify_value(c, k).alias("r")) for k, c in (("url", "download_url"), ("version", "app_new_version"))]
    return parts[0].union(parts[1]).select("name", "kind", "r.status", "r.reason")


def needs_resolution(labels: DataFrame) -> DataFrame:
    """(name), sorted: labels to resolve on a device: owned by that resolver, or with a shell expression in a field that is still null.

    ``labels`` has name, raw_url, raw_version, download_url, app_new_version, resolution_source and user_context.
    """
    open_ = (is_shell_expression("raw_url") & F.col("download_url").isNull()) | (is_shell_expression("raw_version") & F.col("app_new_version").isNull())
    owned = F.coalesce(F.col("resolution_source") == "macos", F.lit(False))
    return labels.where(~F.coalesce("user_context", F.lit(False)) & (owned | open_) & ~F.col("name").isin(*EXCLUDED_LABELS)).select("name").orderBy("name")


def refresh_candidates(labels: DataFrame, already: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Dynamic labels that are not done, not user-context, and not resolved on a device within ``days``."""
    dynamic = is_shell_expression("raw_url") | is_shell_expression("raw_version")
    recent = F.coalesce((F.col("resolution_source") == "macos") & (F.col("resolved_at") > as_of - F.make_dt_interval(F.lit(days))), F.lit(False))
    df = labels.where(dynamic & ~F.coalesce("user_context", F.lit(False)) & ~recent)
    return df.join(already.select("name"), "name", "left_anti")


def validate_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, errors) of (name, label, type, expected_team_id); excluded teams are in neither."""
    team = F.col("expected_team_id")
    checks = [
        F.when(blank_to_null("name").isNull(), "name: missing"), F.when(blank_to_null("label").isNull(), "label: missing"),
        F.when(F.col("type").isNotNull() & ~F.col("type").isin(*LABEL_TYPES), "type: not allowed"),
        F.when(team.isNotNull() & (team != "Software Update") & (F.length(team) != 10), "expected_team_id: not 10 characters"),
    ]
    df = df.where(~F.coalesce(team.isin(*EXCLUDED_TEAMS), F.lit(False))).withColumn("errors", F.array_compact(F.array(*checks)))
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def type_of_url(url: Column) -> Column:
    """The label type that a url's suffix tells."""
    whens = [F.when(F.lower(url).endswith(s), t) for s, t in URL_TYPES.items()]
    return F.coalesce(*whens)


def generate_labels(apps: DataFrame) -> DataFrame:
    """(slug, content, sources_used, warnings) for every app with a label, cask or installer detail.

    content maps the fields that could be resolved: name (cask, installer title, app, label), type (label,
    app, url suffix, else dmg), downloadURL (cask, literal label value, External installer, app),
    appNewVersion, packageID and expectedTeamID.
    """
    have = {t: F.col(p).isNotNull() for t, p in (("installomator", "label_detail"), ("homebrew_cask", "cask_detail"), ("jamf_app_installer", "installer_detail"))}
    raw = lambda k: first_scalar(F.try_element_at("label_detail.raw", F.lit(k)))
    b = blank_to_null
    name = F.coalesce(b("cask_detail.name"), b("installer_detail.title"), b("name"), raw("name"))
    guessed = type_of_url(F.coalesce(b("cask_detail.url"), b("download_url")))
    given = F.coalesce(raw("type"), b("install_method"))
    literal = F.when(~F.coalesce(raw("downloadURL").startswith("$("), F.lit(False)), raw("downloadURL"))
    external = F.when(F.col("installer_detail.source") == "External", b("installer_detail.download_url"))
    fields = {
        "name": name, "type": F.coalesce(given, guessed, F.lit("dmg")), "downloadURL": F.coalesce(b("cask_detail.url"), literal, external, b("download_url")),
        "appNewVersion": b("current_version"), "packageID": b("bundle_id"), "expectedTeamID": raw("expectedTeamID"),
    }
    df = apps.where(reduce(lambda x, y: x | y, have.values())).withColumn("f", F.struct(*(v.alias(k) for k, v in fields.items()))).withColumns({"given": given, "guessed": guessed})
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"f.{k}").alias("value")) for k in fields)), lambda x: x["value"].isNotNull())
    warnings = F.array_compact(
        F.array(
            F.when(F.col("given").isNull() & F.col("guessed").isNotNull(), F.concat(F.lit("type inferred from url: "), F.col("guessed"))),
            F.when(F.col("given").isNull() & F.col("guessed").isNull(), "type unknown, dmg assumed"),
            F.when(F.col("f.downloadURL").isNull(), "downloadURL unknown"),
            F.when(F.col("f.expectedTeamID").isNull(), "expectedTeamID unknown"),
            F.when(F.col("f.appNewVersion").isNull(), "appNewVersion unknown"),
        )
    )
    used = F.array_compact(F.array(*(F.when(c, t) for t, c in have.items())))
    return df.select("slug", F.map_from_entries(pairs).alias("content"), used.alias("sources_used"), warnings.alias("warnings"))


def label_readiness(generated: DataFrame) -> DataFrame:
    """(slug, missing, arguments): required fields that are missing, and the rest as shell-quoted key=value words."""
    required = F.array(*(F.lit(k) for k in ("name", "type", "downloadURL", "expectedTeamID")))
    missing = F.filter(required, lambda k: ~F.map_contains_key("content", k))
    args = F.transform(F.array_sort(F.map_entries("content")), lambda e: F.concat(e["key"], F.lit("="), shell_quote(e["value"])))
    return generated.select("slug", missing.alias("missing"), F.array_join(args, " ").alias("arguments"))
