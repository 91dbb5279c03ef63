"""The registered queries over titles, snapshots, devices and catalogs, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.versions import parse_version
from ..operators import catalog, compliance, diff, incremental, labels, lines, matching, reports, search, stitch, titles, trends
from ..sources import catalogs, snapshots, storage
from ..sources import titles as hydrate
from ..streaming import files
from .standins import SNAPSHOTS, SQL, TITLES, Tables

AS_OF = "2001-11-05 00:00:00"
SNAP_AS_OF = "2001-12-31 12:00:00"
QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def add(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = (plan, sql)


def at(text: str):
    return F.lit(text).cast("timestamp")


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"


NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"
norm = NORM.format
#: The mean of hundredths, exact and so independent of the order of rows; ties to even.
_S, _N = "abs(sum(CAST(round(100 * {0}) AS BIGINT)))", "count({0})"
MEAN = f"(sign(sum(round(100 * {{0}}))) * ({_S} // {_N} + CASE WHEN 2 * ({_S} % {_N}) > {_N} OR (2 * ({_S} % {_N}) = {_N} AND ({_S} // {_N}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE)"
PCT = "printf('%.2f', round_even({0}, 2)) || '%'"
TITLE_COLS = ("title", "title_id", "released", "hosts_patched", "missing_patch", "total_hosts", "completion_percent", "latest_version")
T_SQL = ", ".join(TITLE_COLS)


def t_query(name: str, plan: Callable[[DataFrame], DataFrame], tail: str, extra: str = "") -> None:
    """A query over ``titles`` that returns title rows."""
    more = [c.split(" AS ")[-1].strip() for c in extra.split(";") if c]
    select = T_SQL + "".join(f", {c}" for c in extra.split(";") if c)
    add(name, lambda t: plan(t.titles).select(*TITLE_COLS, *more), f"WITH {TITLES}\nSELECT {select} FROM titles {tail}")


# --- sources and hydration -------------------------------------------------------------------------


def _round_trip(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "snapshots")
    df = t.snapshots
    df.withColumn("snapshot_date", F.to_date("snapshot_ts")).write.partitionBy("snapshot_date").parquet(path)
    return snapshots.read_snapshots(t.spark, path, min_snapshots=2)


def _written(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "snapshot")
    snapshots.write_snapshot(t.titles, path, at(AS_OF))
    df = snapshots.read_snapshots(t.spark, path)
    return df.groupBy("snapshot_ts", "sources").agg(F.count("*").alias("n"), F.sum("hosts_patched").alias("patched"))


SNAP_COLS = ("snapshot_ts", "title", "title_id", "released", "hosts_patched", "missing_patch", "latest_version", "completion_percent")
add("a01_read_snapshots", lambda t: _round_trip(t).select(*SNAP_COLS), f"WITH {SNAPSHOTS}\nSELECT {', '.join(SNAP_COLS)} FROM snaps")
add("a02_normalize_columns", lambda t: snapshots.normalize_columns(t.table("part").select(F.col("p_name").alias("Part Name"), F.col("p_size").alias("SIZE"))), "SELECT p_name AS part_name, p_size AS size FROM part")
add(
    "a03_write_snapshot", _written,
    f"""WITH {TITLES}
SELECT TIMESTAMP '{AS_OF}' AS snapshot_ts, CASE src WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"installomator":["app' || title_id || '"]}}' WHEN 2 THEN '{{"homebrew_cask":["app' || title_id || '"]}}'
 ELSE '{{"installomator":["app' || title_id || '"],"homebrew_cask":["app' || title_id || '"]}}' END AS sources, count(*) AS n, CAST(sum(hosts_patched) AS BIGINT) AS patched FROM titles GROUP BY ALL""",
)
add(
    "a04_expire_snapshots", lambda t: snapshots.expire_snapshots(t.snapshots, at(SNAP_AS_OF), 400).groupBy("snapshot_ts").agg(F.count("*").alias("n")),
    f"WITH {SNAPSHOTS}\nSELECT snapshot_ts, count(*) AS n FROM snaps WHERE snapshot_ts >= TIMESTAMP '{SNAP_AS_OF}' - INTERVAL 400 DAY GROUP BY 1",
)
_summaries = lambda t: t.standin("titles_raw").select("title", F.col("title_id").alias("softwareTitleId"), F.concat(F.date_format(x.released_at("released"), "yyyy-MM-dd"), F.lit("T23:30:00-07:00")).alias("releaseDate"), F.col("hosts_patched").alias("upToDate"), F.col("missing_patch").alias("outOfDate"), F.col("latest_version").alias("latestVersion"))
add("a05_titles_from_summaries", lambda t: hydrate.derive_title_metrics(hydrate.titles_from_summaries(_summaries(t))).select(*TITLE_COLS), f"WITH {TITLES}\nSELECT {T_SQL} FROM titles")
t_query("a06_derive_title_metrics", lambda df: df, "")
add(
    "a07_attach_name_id",
    lambda t: hydrate.attach_name_id(t.titles, t.table("part").select(F.col("p_partkey").alias("softwareTitleId"), F.col("p_brand").alias("softwareTitleNameId"), F.col("p_size").alias("ord")).where("p_partkey % 3 > 0")).select("title_id", "name_id"),
    f"WITH {TITLES}\nSELECT title_id, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS name_id FROM titles JOIN part ON CAST(p_partkey AS VARCHAR) = title_id",
)


def _hydrated(t: Tables) -> DataFrame:
    raw = t.standin("titles_raw").select("title_id", F.col("title").alias("Title"), F.col("released").alias("Released"), F.when(F.col("src") == 1, "many").otherwise(F.col("hosts_patched").cast("string")).alias("Hosts Patched"), F.col("missing_patch").alias("Missing Patch"), F.when(F.col("src") != 2, F.col("latest_version")).alias("Latest Version"))
    good, bad = hydrate.hydrate_titles(raw)
    return good.select("title_id", "completion_percent", F.lit("").alias("errors")).union(bad.select("title_id", F.lit(None).cast("double"), F.array_join("errors", "; ")))


add(
    "a08_hydrate_titles", _hydrated,
    f"""WITH {TITLES}
SELECT title_id, CASE WHEN src NOT IN (1, 2) THEN completion_percent END AS completion_percent,
 CASE src WHEN 1 THEN 'hosts_patched: not a long' WHEN 2 THEN 'latest_version: missing' ELSE '' END AS errors FROM titles""",
)
add(
    "a09_hydrate_report",
    lambda t: hydrate.hydrate_report(t.standin("titles_raw").select(F.col("title_id").cast("int").alias("ord"), F.col("title").alias("Title"), F.col("released").alias("Released"), F.col("hosts_patched").cast("string").alias("Hosts Patched"), F.col("missing_patch").cast("string").alias("Missing Patch"), F.col("latest_version").alias("Latest Version")))[0].select("title_id", "title", "completion_percent"),
    f"WITH {TITLES}\nSELECT CAST(row_number() OVER (ORDER BY CAST(title_id AS INT)) - 1 AS VARCHAR) AS title_id, title, completion_percent FROM titles",
)


def _device_source(t: Tables) -> DataFrame:
    d = t.standin("devices")
    back = {b: a for a, b in hydrate._DEVICE.items()}
    return d.select("title_id", *(F.col(c).alias(back[c]) for c in back))


add(
    "a10_device_reports", lambda t: hydrate.device_rows(_device_source(t)).groupBy("title_id").agg(F.count("*").alias("devices"), F.count("building_name").alias("with_building"), F.max("last_contact_time").alias("last_contact")),
    cte("devices") + "SELECT title_id, count(*) AS devices, count(nullif(building_name, '')) AS with_building, max(last_contact_time) AS last_contact FROM devices GROUP BY 1",
)


def _device_csv(t: Tables) -> DataFrame:
    """Device reports as CSV files, a folder for each site, read back."""
    path = storage.shared_path(t.spark, "devices")
    hydrate.write_device_reports(_device_source(t).withColumn("title_id", F.col("siteName")), path)
    return hydrate.read_device_reports(t.spark, path)


add(
    "a10_device_csv", lambda t: _device_csv(t).groupBy("title_id").agg(F.count("*").alias("devices"), F.count("building_name").alias("with_building"), F.max("last_contact_time").alias("last_contact"), F.max("device_id").alias("last_device")),
    cte("devices") + "SELECT site_name AS title_id, count(*) AS devices, count(nullif(building_name, '')) AS with_building, max(last_contact_time) AS last_contact, max(device_id) AS last_device FROM devices GROUP BY 1",
)
add(
    "a11_app_names_from_definitions",
    lambda t: hydrate.app_names_from_definitions(t.standin("title_app_names").select("title_id", F.array(F.struct(F.array(F.struct(F.col("app_name").alias("appName")), F.struct(F.lit(" ").alias("appName"))).alias("killApps"))).alias("results"))).select("title_id", F.array_join("app_names", "|").alias("app_names")),
    cte("title_app_names") + "SELECT title_id, app_name AS app_names FROM title_app_names",
)
add(
    "a12_titles_envelope",
    lambda t: hydrate.titles_envelope(t.titles.select("title_id", "title", "hosts_patched"), "Fleet", at(AS_OF)).select("report_title", "title_count", F.explode(F.from_json("titles", "array<struct<title_id:string,title:string,hosts_patched:long>>")).alias("x")).select("report_title", "title_count", "x.*"),
    f"WITH {TITLES}\nSELECT 'Fleet' AS report_title, (SELECT count(*) FROM titles) AS title_count, title_id, title, hosts_patched FROM titles",
)


def _envelope_files(t: Tables) -> DataFrame:
    """The envelope's files, read back line by line: its head and its titles."""
    path = storage.shared_path(t.spark, "envelope")
    hydrate.write_titles_envelope(t.titles.select("title_id", "title", "hosts_patched"), "Fleet", at(AS_OF), path)
    lines = t.spark.read.text(path)
    head = lines.where(F.col("value").endswith('"titles":[')).select(F.from_json(F.concat("value", F.lit("]}")), "report_title string, title_count long").alias("h")).select("h.*")
    rows = lines.where(F.col("value").rlike('^,?[{]"title_id"')).select(F.from_json(F.ltrim("value", F.lit(",")), "title_id string, title string, hosts_patched long").alias("x")).select("x.*")
    return rows.join(F.broadcast(head))  # one row


add("a12_envelope_files", _envelope_files, QUERIES["a12_titles_envelope"][1])


def _titles_ndjson(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "titles")
    hydrate.write_titles_ndjson(t.titles.select("title_id", "title", "hosts_patched", "completion_percent"), path)
    return t.spark.read.schema("title_id string, title string, hosts_patched long, completion_percent double").json(path)


add("a12_titles_ndjson", _titles_ndjson, f"WITH {TITLES}\nSELECT title_id, title, hosts_patched, completion_percent FROM titles")


def _cask_feed(t: Tables) -> DataFrame:
    j = F.to_json(F.struct(F.when(F.col("ord") % 7 > 0, F.col("token")).alias("token"), F.array("name").alias("name"), "url", "version"))
    return t.casks.select("ord", F.when(F.col("ord") % 5 == 0, F.regexp_replace(j, r"\[(\"[^\"]*\")\]", "$1")).otherwise(j).alias("record"))


add(
    "a13_ingest_casks", lambda t: catalogs.ingest_casks(_cask_feed(t), at(AS_OF))[0].select("token", "name", "url", "version"),
    cte("cask_rows") + "SELECT token, name, url, version FROM cask_rows WHERE ord % 7 > 0 AND ord % 5 > 0",
)
add("a13_ingest_cask_counts", lambda t: catalogs.ingest_casks(_cask_feed(t), at(AS_OF))[1], cte("cask_rows") + "SELECT count(*) FILTER (ord % 7 > 0 AND ord % 5 > 0) AS ingested, count(*) FILTER (NOT (ord % 7 > 0 AND ord % 5 > 0)) AS skipped FROM cask_rows")


def _recipe_index(t: Tables) -> DataFrame:
    no_repo = F.col("repo").startswith("sup1")
    entry = F.when(F.col("name").startswith("b"), F.lit("7")).otherwise(F.to_json(F.struct("name", F.when(~no_repo, F.col("repo")).alias("repo"), "path", "inferred_type")))
    return t.recipes.withColumn("entry", entry).select(F.create_map("identifier", "entry").alias("identifiers"))


_BAD = "CASE WHEN name LIKE 'b%' THEN 'not an object' WHEN repo LIKE 'sup1%' THEN 'missing repo' END"
add("a14_ingest_recipes", lambda t: catalogs.ingest_recipes(_recipe_index(t), at(AS_OF)).select("identifier", "name", "repo", "path"), cte("recipe_rows") + f"SELECT identifier, name, repo, path FROM recipe_rows WHERE {_BAD} IS NULL")
add(
    "a15_recipe_skip_reasons", lambda t: catalogs.recipe_skip_reasons(catalogs.recipe_entries(_recipe_index(t))).select("reason", "n", F.array_join("examples", " ").alias("examples")),
    cte("recipe_rows") + f"SELECT reason, count(*) AS n, array_to_string(list_slice(list_sort(list(identifier)), 1, 3), ' ') AS examples FROM (SELECT {_BAD} AS reason, identifier FROM recipe_rows) WHERE reason IS NOT NULL GROUP BY 1",
)
add(
    "a16_ingest_installers",
    lambda t: catalogs.ingest_installers(t.installers.select("ord", F.col("title").alias("title_name"), F.when(F.col("source") == "Jamf", "jamf_server").alias("media_source_type"), F.array(F.struct(F.col("download_url").alias("url"))).alias("media_sources"), "bundle_id", F.lit("").alias("version"), F.col("version").alias("short_version"), F.col("jamf_id").alias("id"), F.lit("").alias("architecture"))).select("title", "source", "host", "bundle_id", "version", "jamf_id", "download_url"),
    cte("installer_rows") + "SELECT title, source, CASE WHEN source = 'External' THEN 'vendor.example.org' END AS host, bundle_id, version, jamf_id, download_url FROM installer_rows",
)


def _xml_titles(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "titles-xml")
    df = t.standin("catalog_title_rows").withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))
    df.write.format("xml").option("rowTag", "available_title").option("rootTag", "available_titles").save(path)
    return catalogs.read_catalog_titles(t.spark, path)


add("a17_read_catalog_titles", _xml_titles, cte("catalog_title_rows") + "SELECT name_id, app_name, publisher, current_version, last_modified FROM catalog_title_rows")
_UP = "SELECT name, 'v' || (ord % 5) AS sha FROM label_rows WHERE ord % 9 > 0"
_EX = "SELECT name, 'v' || (ord % 4) AS blob_sha FROM label_rows WHERE ord % 8 > 0"
add(
    "a18_sha_gate", lambda t: catalogs.sha_gate(t.labels.where("ord % 9 > 0").selectExpr("name", "'v' || (ord % 5) AS sha"), t.labels.where("ord % 8 > 0").selectExpr("name", "'v' || (ord % 4) AS blob_sha")),
    cte("label_rows") + f"SELECT name, CASE WHEN sha IS NULL THEN 'removed' WHEN sha IS DISTINCT FROM blob_sha THEN 'changed' ELSE 'unchanged' END AS state FROM ({_UP}) FULL JOIN ({_EX}) USING (name)",
)
add(
    "a19_tree_to_labels", lambda t: catalogs.tree_to_labels(t.table("part").selectExpr("CASE p_partkey % 3 WHEN 0 THEN 'fragments/labels/App' || p_partkey || '.sh' WHEN 1 THEN 'fragments/x/' || p_partkey || '.sh' ELSE 'fragments/labels/d/' || p_partkey || '.sh' END AS path", "CASE WHEN p_partkey % 2 = 0 THEN 'blob' ELSE 'tree' END AS type", "p_brand AS sha")),
    "SELECT 'app' || p_partkey AS name, p_brand AS sha FROM part WHERE p_partkey % 6 = 0",
)
add(
    "a20_upsert", lambda t: storage.upsert(t.casks.select("token", "version", "ord"), t.casks.where("ord % 3 = 0").selectExpr("token", "version || 'b' AS version", "ord").union(t.casks.where("ord % 3 = 0").selectExpr("token", "version || 'a' AS version", "ord - 1")).union(t.casks.where("ord % 5 = 0").selectExpr("token || 'n' AS token", "version", "ord")), ["token"]),
    cte("cask_rows") + "SELECT token, CASE WHEN ord % 3 = 0 THEN version || 'b' ELSE version END AS version, ord FROM cask_rows UNION ALL SELECT token || 'n', version, ord FROM cask_rows WHERE ord % 5 = 0",
)


def _cask_updates(t: Tables) -> DataFrame:
    last, first = t.casks.where("ord % 3 = 0").selectExpr("token", "version || 'b' AS version", "ord"), t.casks.where("ord % 3 = 0").selectExpr("token", "version || 'a' AS version", "ord - 1")
    return last.union(first).union(t.casks.where("ord % 5 = 0").selectExpr("token || 'n' AS token", "version", "ord"))


def _upserted_in_place(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "casks")
    storage.write_bucketed(t.casks.select("token", "version", "ord"), path, ["token"], 16)
    storage.upsert_bucketed(_cask_updates(t), path)
    return storage.read_bucketed(t.spark, path)


def _upserted_from_files(t: Tables) -> DataFrame:
    """The same updates as files that land in two lots, the older ones first, each taken in by a run of the file stream."""
    path, folder, done = (storage.shared_path(t.spark, x) for x in ("casks", "landing", "done"))
    storage.write_bucketed(t.casks.select("token", "version", "ord"), path, ["token"], 16)
    rows = _cask_updates(t)
    for lot in (rows.where("version like '%a'"), rows.where("version not like '%a'")):
        lot.write.mode("append").json(folder)
        files.take_in(t.spark, folder, rows.schema, path, done, ord="ord")
    return storage.read_bucketed(t.spark, path)


add("a20_upsert_in_place", _upserted_in_place, QUERIES["a20_upsert"][1])
add("a20_upsert_from_files", _upserted_from_files, QUERIES["a20_upsert"][1])
_RES = cte("label_rows", "resolved") + """, r AS (SELECT ord, label, ok, replace(downloadURL, '&amp;', '&') AS url, appNewVersion AS version FROM resolved),
f AS (SELECT r.*, l.name IS NOT NULL AS known, url LIKE 'http%' AS gu, version NOT LIKE '%<%' AND version IS NOT NULL AS gv FROM r LEFT JOIN label_rows l ON l.name = r.label)"""
_RES = _RES.replace("\n, r AS", ", r AS")
add("a21_merge_resolved_summary", lambda t: catalogs.merge_resolved(t.labels, t.standin("resolved"), at(AS_OF))[1],
    _RES + " SELECT count(*) AS received, count(*) FILTER (label IS NULL) AS malformed, count(*) FILTER (NOT ok) AS not_ok, count(*) FILTER (ok AND NOT known) AS unknown, count(*) FILTER (ok AND known AND (NOT gu OR NOT gv)) AS invalid, count(*) FILTER (ok AND known AND (gu OR gv)) AS updated FROM f")
add("a21_merge_resolved", lambda t: catalogs.merge_resolved(t.labels, t.standin("resolved"), at(AS_OF))[0].select("name", "download_url", "app_new_version", "resolution_source", "resolved_at"),
    _RES + f""", b AS (SELECT label, max_by(url, ord) FILTER (gu) AS u, max_by(version, ord) FILTER (gv) AS v FROM f WHERE ok AND known GROUP BY 1)
SELECT name, coalesce(u, download_url) AS download_url, coalesce(v, app_new_version) AS app_new_version, CASE WHEN u IS NOT NULL OR v IS NOT NULL THEN 'macos' END AS resolution_source,
 CASE WHEN u IS NOT NULL OR v IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS resolved_at FROM label_rows LEFT JOIN b ON label = name""")  # fmt: skip
add("a22_label_names", lambda t: catalogs.label_names(t.table("documents").select(F.explode(F.split("text", "\n")).alias("line"))),
    "SELECT DISTINCT lower(trim(line)) AS name FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND lower(trim(line)) NOT LIKE '#%'")

# --- filters, sorts and top-k ----------------------------------------------------------------------

t_query("b01_sort_titles", lambda df: titles.sort_titles(df, "Total Hosts"), "")
t_query("b02_omit_recent", lambda df: titles.omit_recent(df, at(AS_OF)), f"WHERE day < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR")
t_query("b03_most_installed", lambda df: titles.most_installed(df, 25), "ORDER BY total_hosts DESC, title, title_id LIMIT 25")
t_query("b04_least_installed", lambda df: titles.least_installed(df, 25), "ORDER BY total_hosts, title, title_id LIMIT 25")
t_query("b05_oldest_least_complete", lambda df: titles.oldest_least_complete(df, 25), "ORDER BY released, completion_percent, title, title_id LIMIT 25")
t_query("b06_below_threshold", lambda df: titles.below_threshold(df), "WHERE completion_percent < 70")
t_query("b07_high_missing", lambda df: titles.high_missing(df, 25), "WHERE missing_patch > total_hosts * 0.5 ORDER BY missing_patch, title, title_id LIMIT 25")
t_query("b08_recent_release", lambda df: titles.recent_release(df, at(AS_OF), 25), f"WHERE day >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY released DESC, title, title_id LIMIT 25")
t_query("b09_zero_completion", titles.zero_completion, "WHERE completion_percent = 0")
t_query("b10_top_performers", lambda df: titles.top_performers(df, 25), "WHERE completion_percent > 90 ORDER BY completion_percent DESC, title, title_id LIMIT 25")
t_query("b11_installomator_covered", lambda df: titles.installomator_covered(df, 25), "WHERE src IN (1, 3) ORDER BY title, title_id LIMIT 25")
_SCORE = f"CAST(missing_patch * greatest(floor(epoch(TIMESTAMP '{AS_OF}' - day) / 86400), 0) AS BIGINT)"
t_query("b12_impact_weighted_risk", lambda df: titles.impact_weighted_risk(df, at(AS_OF), 25), f"WHERE day IS NOT NULL ORDER BY {_SCORE} DESC, title, title_id LIMIT 25", f"{_SCORE} AS score")
t_query("b13_coverage_gaps", lambda df: titles.coverage_gaps(df, 25), "WHERE src = 0 ORDER BY missing_patch DESC, title, title_id LIMIT 25")
t_query("b14_where_titles", lambda df: titles.where_titles(df, 40.0, 20, "1998-06-01"), "WHERE completion_percent >= 40 AND total_hosts >= 20 AND day >= TIMESTAMP '1998-06-01'")
t_query("b15_apply_criterion", lambda df: titles.apply_criterion(df, "most-installed", where={"min_hosts": 25}, top_n=10, threshold=5), "WHERE total_hosts >= 25 ORDER BY total_hosts DESC, title, title_id LIMIT 10")

# --- trends ----------------------------------------------------------------------------------------


def s_query(name: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda t: plan(t.snapshots), f"WITH {SNAPSHOTS}\n{sql}")


_ADOPT = f"SELECT title, {PCT.format(MEAN.format('completion_percent'))} AS completion_percent, strftime(max(day), '%Y-%m-%d') AS released FROM snaps GROUP BY 1"
s_query("c01_patch_adoption", trends.patch_adoption, _ADOPT)
s_query("c02_release_frequency", trends.release_frequency, "SELECT title, count(DISTINCT day) AS release_count FROM snaps GROUP BY 1")
s_query("c03_completion_trends", trends.completion_trends, f"SELECT strftime(day, '%Y-%m-%d') AS released, title, {PCT.format(MEAN.format('completion_percent'))} AS completion_percent FROM snaps GROUP BY day, title")
_DAYS = "floor(epoch(snapshot_ts - day) / 86400)"
s_query("c04_time_to_patch", trends.time_to_patch, f"SELECT title, round_even(avg({_DAYS}), 2) AS avg_days, count(*) AS sample_size, 80.0::DOUBLE AS threshold FROM snaps WHERE completion_percent >= 80 AND day IS NOT NULL GROUP BY 1")
s_query("c04_first_crossing", lambda s: trends.time_to_patch(s, 80.0, first_crossing_only=True), f"SELECT title, min_by({_DAYS}, snapshot_ts)::DOUBLE AS avg_days, 1::BIGINT AS sample_size, 80.0::DOUBLE AS threshold FROM snaps WHERE completion_percent >= 80 AND day IS NOT NULL GROUP BY 1")
s_query("c05_stale_apps", trends.stale_apps, "SELECT title, min(latest_version) AS latest_version, min(p) AS completion_percent, CAST(floor(epoch(max(snapshot_ts) - min(snapshot_ts)) / 86400) AS BIGINT) AS days_stale FROM (SELECT *, round_even(completion_percent, 2) AS p, row_number() OVER (PARTITION BY title ORDER BY snapshot_ts DESC) AS r FROM snaps) WHERE r <= 3 GROUP BY title HAVING count(*) = 3 AND count(DISTINCT latest_version) = 1 AND count(DISTINCT p) = 1")
s_query("c06_excluded_titles", trends.excluded_titles, "SELECT count(*) AS excluded FROM (SELECT title FROM snaps GROUP BY 1 HAVING NOT coalesce(bool_or(completion_percent >= 80 AND day IS NOT NULL), false))")
s_query("c07_sort_trend", lambda s: trends.sort_trend(trends.patch_adoption(s), "released", ascending=False), _ADOPT)
s_query("c08_apply_trend", lambda s: trends.apply_trend(s, "release-frequency", "release_count"), "SELECT title, count(DISTINCT day) AS release_count FROM snaps GROUP BY 1")


def _state(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The trend state after all snapshots: built over all but the newest, which arrives alone."""
    path, state = storage.shared_path(t.spark, "history"), storage.shared_path(t.spark, "state")
    t.snapshots.withColumn("snapshot_date", F.to_date("snapshot_ts")).write.partitionBy("snapshot_date").parquet(path)
    table = t.spark.read.parquet(path)
    newest = table.agg(F.max("snapshot_date")).first()[0]
    incremental.update_trends(table.where(F.col("snapshot_date") < F.lit(newest)), state)
    incremental.update_trends(table, state)
    return incremental.read_state(t.spark, state)


_CROSSED = f"SELECT title, round_even(avg({_DAYS}), 2) AS avg_days, count(*) AS sample_size, 80.0::DOUBLE AS threshold FROM snaps WHERE completion_percent >= 80 AND day IS NOT NULL GROUP BY 1"
add("c01_adoption_from_state", lambda t: incremental.patch_adoption(_state(t)[0]), f"WITH {SNAPSHOTS}\n{_ADOPT}")
add("c03_trends_from_state", lambda t: incremental.completion_trends(_state(t)[0]), QUERIES["c03_completion_trends"][1])
add("c04_time_to_patch_from_state", lambda t: incremental.time_to_patch(_state(t)[0]), f"WITH {SNAPSHOTS}\n{_CROSSED}")
add("c05_stale_apps_from_state", lambda t: trends.stale_apps(_state(t)[1]), QUERIES["c05_stale_apps"][1])

# --- snapshot selection and diff -------------------------------------------------------------------

s_query("d01_list_snapshots", diff.list_snapshots, "SELECT DISTINCT snapshot_ts, 'snapshot-' || strftime(snapshot_ts, '%Y-%m-%dT%H:%M:%S') AS label FROM snaps")
s_query("d02_latest_snapshot", lambda s: diff.latest_snapshot(s).select(*SNAP_COLS), f"SELECT {', '.join(SNAP_COLS)} FROM snaps WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM snaps)")
s_query("d03_closest_snapshot", lambda s: diff.closest_snapshot(s, date(1998, 7, 2)), "SELECT snapshot_ts FROM (SELECT DISTINCT snapshot_ts FROM snaps) ORDER BY abs(epoch(snapshot_ts - TIMESTAMP '1998-07-02')), snapshot_ts LIMIT 1")
add(
    "d03_closest_snapshots", lambda t: diff.closest_snapshots(t.snapshots, t.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))).select("o_orderkey", "snapshot_ts"),
    f"""WITH {SNAPSHOTS}, times AS (SELECT DISTINCT snapshot_ts FROM snaps), days AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS day FROM orders),
near AS (SELECT day, arg_min(snapshot_ts, (abs(epoch(snapshot_ts - day)), snapshot_ts)) AS snapshot_ts FROM days, times GROUP BY day)
SELECT o_orderkey, snapshot_ts FROM orders JOIN near ON day = CAST(o_orderdate AS TIMESTAMP)""",
)
s_query("d04_select_baseline", lambda s: diff.select_baseline(s, at(SNAP_AS_OF), since="750d"), f"SELECT min(snapshot_ts) AS snapshot_ts FROM snaps WHERE snapshot_ts >= TIMESTAMP '{SNAP_AS_OF}' - INTERVAL 750 DAY")


def _pair(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The two newest years; titles that ship in only one of them come and go."""
    return diff.diff_pair(t.snapshots)


PAIR = f"""WITH {SNAPSHOTS},
times AS (SELECT DISTINCT snapshot_ts FROM snaps ORDER BY 1 DESC LIMIT 2),
f AS (SELECT * FROM snaps WHERE snapshot_ts = (SELECT min(snapshot_ts) FROM times)),
t AS (SELECT * FROM snaps WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM times)),
ch AS (SELECT title_id, t.title, f.completion_percent AS from_completion_percent, t.completion_percent AS to_completion_percent, f.total_hosts AS from_total_hosts, t.total_hosts AS to_total_hosts,
 f.latest_version AS from_latest_version, t.latest_version AS to_latest_version, round_even(t.completion_percent - f.completion_percent, 2) AS delta, f.latest_version IS DISTINCT FROM t.latest_version AS version_changed
 FROM f JOIN t USING (title_id) WHERE f.completion_percent <> t.completion_percent OR f.hosts_patched <> t.hosts_patched OR f.total_hosts <> t.total_hosts OR f.latest_version IS DISTINCT FROM t.latest_version)
"""
_CH = ("title_id", "title", "from_completion_percent", "to_completion_percent", "from_total_hosts", "to_total_hosts", "from_latest_version", "to_latest_version", "delta", "version_changed")
add("d05_diff_pair", lambda t: diff.diff_pair(t.snapshots, between=(date(1997, 1, 1), date(1999, 1, 1)))[0].groupBy("snapshot_ts").agg(F.count("*").alias("n")), f"WITH {SNAPSHOTS}\nSELECT snapshot_ts, count(*) AS n FROM snaps WHERE snapshot_ts = TIMESTAMP '1996-12-31 12:00:00' GROUP BY 1")
add("d06_added", lambda t: diff.added(*_pair(t)).select("title_id", "title"), PAIR + "SELECT title_id, title FROM t WHERE title_id NOT IN (SELECT title_id FROM f)")
add("d07_removed", lambda t: diff.removed(*_pair(t)).select("title_id", "title"), PAIR + "SELECT title_id, title FROM f WHERE title_id NOT IN (SELECT title_id FROM t)")
add("d08_changed", lambda t: diff.changed(*_pair(t)).select(*_CH), PAIR + f"SELECT {', '.join(_CH)} FROM ch")
add("d09_version_bumps", lambda t: diff.version_bumps(diff.changed(*_pair(t))).select("title_id", "to_latest_version"), PAIR + "SELECT title_id, to_latest_version FROM ch WHERE version_changed")
add("d10_diff_summary", lambda t: diff.diff_summary(*_pair(t)), PAIR + f"""SELECT (SELECT count(*) FROM f) AS from_rows, (SELECT count(*) FROM t) AS to_rows, (SELECT count(*) FROM t ANTI JOIN f USING (title_id)) AS added, (SELECT count(*) FROM f ANTI JOIN t USING (title_id)) AS removed,
 count(*) AS changed, (SELECT count(*) FROM f JOIN t USING (title_id)) - count(*) AS unchanged, {MEAN.format('delta')} AS avg_delta, count(*) FILTER (version_changed) AS version_bumps FROM ch""")

# --- OS compliance ---------------------------------------------------------------------------------


def _feed(t: Tables) -> DataFrame:
    """The newest version that any device of a major version runs, as a feed."""
    return compliance.flatten_os_feed(_seen(t).agg(F.array_sort(F.collect_list(F.struct("OSVersion", "Latest"))).alias("OSVersions")))


_IOS = cte("ios_devices") + """, feed AS (SELECT split_part(os_version, '.', 1) AS major, max(os_version) AS latest FROM ios_devices GROUP BY 1),
os AS (SELECT 'iOS ' || latest AS title, 'iOS' AS title_id, 'Oct 01 2001' AS released, count(*) FILTER (os_version = latest) AS hosts_patched, count(*) FILTER (os_version <> latest) AS missing_patch, count(*) AS total_hosts,
 round_even(100.0::DOUBLE * count(*) FILTER (os_version = latest) / count(*), 2) AS completion_percent, latest AS latest_version FROM ios_devices JOIN feed ON major = split_part(os_version, '.', 1) GROUP BY latest)
"""
_IOS = _IOS.replace("\n, feed", ", feed")
_seen = lambda t: t.standin("ios_devices").groupBy(F.split_part("os_version", F.lit("."), F.lit(1)).alias("OSVersion")).agg(F.struct(F.max("os_version").alias("ProductVersion"), F.lit("2001-10-01T00:00:00Z").alias("ReleaseDate")).alias("Latest"))
add("e01_flatten_os_feed", lambda t: compliance.flatten_os_feed(_seen(t).agg(F.array_sort(F.collect_list(F.struct("OSVersion", "Latest"))).alias("OSVersions"))).select("ord", "os_version", "product_version"),
    cte("ios_devices") + "SELECT CAST(row_number() OVER (ORDER BY os_version) - 1 AS INT) AS ord, os_version, product_version FROM (SELECT split_part(os_version, '.', 1) AS os_version, max(os_version) AS product_version FROM ios_devices GROUP BY 1)")
_details = lambda t: t.standin("ios_devices").select(F.col("user_id").cast("string").alias("serialNumber"), F.col("os_version").alias("osVersion"))
add("e02_device_os_versions", lambda t: compliance.device_os_versions(_details(t)), cte("ios_devices") + "SELECT CAST(user_id AS VARCHAR) AS serial_number, os_version FROM ios_devices")
add("e03_os_compliance", lambda t: compliance.os_compliance(t.standin("ios_devices"), _feed(t)).select(*TITLE_COLS), _IOS + f"SELECT {T_SQL} FROM os")
add("e04_append_os_status", lambda t: compliance.append_os_status(t.titles, compliance.os_compliance(t.standin("ios_devices"), _feed(t))).select(*TITLE_COLS), _IOS.rstrip() + f",\n{TITLES}\nSELECT {T_SQL} FROM titles UNION ALL SELECT {T_SQL} FROM os")

# --- catalog: stitch -------------------------------------------------------------------------------

_ED, _VE = "|".join(stitch.EDITIONS), "|".join(stitch.VENDORS)
APPS = (
    cte("label_rows", "cask_rows", "recipe_rows", "installer_rows").rstrip()
    + f""",
lc AS (SELECT l.*, coalesce(c1.token, c2.token) AS token FROM label_rows l LEFT JOIN cask_rows c1 ON c1.token = l.name LEFT JOIN cask_rows c2 ON c2.app_artifact = l.display_name || '.app'),
rk AS (SELECT {norm("name")} AS key, count(*) AS n_recipes, array_to_string(list_sort(list(identifier)), ' ') AS ids, array_to_string(list_sort(list(DISTINCT repo)), '|') AS repos FROM recipe_rows GROUP BY 1),
tok AS (SELECT title, ord, {norm("title")} AS exact, regexp_replace(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '( (v?[0-9]+|{_ED}))+$', '') AS short FROM installer_rows),
ks AS (SELECT title, ord, exact AS key, 0 AS tier, 0 AS pos FROM tok UNION ALL SELECT title, ord, replace(short, ' ', ''), 1, 1 FROM tok UNION ALL
 SELECT title, ord, replace(regexp_replace(short, '^ ({_VE}) ', ''), ' ', ''), 1, 2 FROM tok WHERE regexp_matches(short, '^ ({_VE}) ')),
ik AS (SELECT key, arg_min(title, (tier, ord, pos)) AS title FROM ks WHERE key <> '' GROUP BY key),
ib AS (SELECT bundle_id AS bundle, arg_max(title, ord) AS title FROM installer_rows WHERE bundle_id <> '' GROUP BY 1),
base AS (SELECT name AS slug, display_name AS name, {norm("display_name")} AS key, package_id AS bundle, token, true AS is_label, package_id, app_new_version, download_url AS l_url, install_type, expected_team_id FROM lc
 UNION ALL SELECT token, name, {norm("name")}, NULL, token, false, NULL, NULL, NULL, NULL, NULL FROM cask_rows WHERE token NOT IN (SELECT token FROM lc WHERE token IS NOT NULL)),
j AS (SELECT b.*, c.name AS c_name, c.url AS c_url, c.version AS c_version, c.sha256, rk.n_recipes, rk.ids, rk.repos, coalesce(ib.title, ik.title) AS i_title
 FROM base b LEFT JOIN cask_rows c ON c.token = b.token LEFT JOIN rk ON rk.key = b.key LEFT JOIN ib ON ib.bundle = b.bundle LEFT JOIN ik ON ik.key = b.key),
k AS (SELECT j.*, i.source AS i_source, i.bundle_id AS i_bundle, i.version AS i_version, i.jamf_id, i.download_url AS i_url FROM j LEFT JOIN installer_rows i ON i.title = j.i_title),
apps AS (SELECT slug, coalesce(bundle, i_bundle) AS bundle_id, name,
 CASE WHEN package_id LIKE '%.%' THEN upper(split_part(package_id, '.', 2)[1]) || split_part(package_id, '.', 2)[2:] ELSE split_part(name, ' ', 1) END AS vendor,
 CASE WHEN is_label THEN coalesce(CASE WHEN app_new_version NOT LIKE '$%' THEN app_new_version END, c_version, i_version) ELSE coalesce(c_version, i_version) END AS current_version,
 coalesce(CASE WHEN l_url LIKE 'http%' THEN l_url END, c_url, CASE WHEN i_source = 'External' THEN i_url END) AS download_url,
 CASE WHEN is_label THEN CASE WHEN install_type IN ('dmg', 'pkg', 'zip', 'tbz', 'pkgInDmg', 'pkgInZip', 'appInDmgInZip') THEN install_type END
  WHEN lower(c_url) LIKE '%.dmg' THEN 'dmg' WHEN lower(c_url) LIKE '%.pkg' THEN 'pkg' WHEN lower(c_url) LIKE '%.tar.bz2' THEN 'tbz' END AS install_method,
 expected_team_id, sha256, list_filter([CASE WHEN is_label THEN 'installomator' END, CASE WHEN token IS NOT NULL THEN 'homebrew_cask' END, CASE WHEN n_recipes > 0 THEN 'autopkg' END, CASE WHEN i_title IS NOT NULL THEN 'jamf_app_installer' END], lambda s: s IS NOT NULL) AS src,
 is_label, install_type, app_new_version, l_url, token, c_name, c_url, c_version, n_recipes, ids, repos, i_title, i_source, i_url, jamf_id, key FROM k)
"""
)
A_COLS = ("slug", "bundle_id", "name", "vendor", "current_version", "download_url", "install_method", "expected_team_id", "sha256")
A_SQL = ", ".join(A_COLS) + ", array_to_string(src, ',') AS sources"


def flat(apps: DataFrame) -> DataFrame:
    return apps.select(*A_COLS, F.array_join("sources", ",").alias("sources"))


add("i01_cask_app_index", lambda t: stitch.cask_app_index(t.casks), cte("cask_rows") + "SELECT app_artifact AS app_name, token FROM cask_rows")
add("i02_match_casks", lambda t: stitch.match_casks(t.labels, t.casks), APPS + "SELECT name, token FROM lc WHERE token IS NOT NULL")
add("i03_recipes_by_name", lambda t: stitch.recipes_by_name(t.recipes).select("key", F.array_join(F.transform("recipes", lambda r: r["identifier"]), " ").alias("ids")), APPS + "SELECT key, ids FROM rk")
add("i04_installer_keys", lambda t: t.installers.select("title", F.explode(stitch.installer_keys(F.col("title"))).alias("k")).select("title", "k.key").distinct(), APPS + "SELECT DISTINCT title, key FROM ks WHERE key <> ''")
add("i05_installers_by_key", lambda t: stitch.installers_by_key(t.installers), APPS + "SELECT key, title FROM ik")
add("i06_match_installer", lambda t: stitch.match_installer(t.labels.select(F.col("name").alias("slug"), F.col("package_id").alias("bundle"), x.normalize_name("display_name").alias("key")), t.installers), APPS + "SELECT slug, i_title AS title FROM apps WHERE is_label AND i_title IS NOT NULL")
add("i07_bundle_ids", lambda t: t.apps.select("slug", "bundle_id"), APPS + "SELECT slug, bundle_id FROM apps")
add("i08_extract_vendor", lambda t: t.labels.select("name", stitch.extract_vendor(F.col("package_id"), F.col("display_name")).alias("vendor")), APPS + "SELECT slug AS name, vendor FROM apps WHERE is_label")
add("i09_resolve_version", lambda t: t.apps.select("slug", "current_version"), APPS + "SELECT slug, current_version FROM apps")
add("i10_resolve_download_url", lambda t: t.apps.select("slug", "download_url"), APPS + "SELECT slug, download_url FROM apps")
add("i11_install_method", lambda t: t.apps.select("slug", "install_method"), APPS + "SELECT slug, install_method FROM apps")
add("i12_payloads", lambda t: t.apps.select("slug", F.col("label_detail.label_url").alias("label_url"), F.col("cask_detail.token").alias("token"), F.size("recipe_detail").cast("long").alias("recipes"), F.col("installer_detail.jamf_id").alias("jamf_id")),
    APPS + "SELECT slug, CASE WHEN is_label THEN 'fragments/labels/' || slug || '.sh' END AS label_url, token, n_recipes AS recipes, jamf_id FROM apps")
add("i13_canonical_sources", lambda t: t.apps.select("slug", F.array_join("sources", ",").alias("sources")), APPS + "SELECT slug, array_to_string(src, ',') AS sources FROM apps")
add("i14_label_apps", lambda t: flat(stitch.label_apps(t.labels, t.casks, t.recipes, t.installers)), APPS + f"SELECT {A_SQL} FROM apps WHERE is_label")
add("i15_cask_only_apps", lambda t: flat(stitch.cask_only_apps(t.labels, t.casks, t.recipes, t.installers)), APPS + f"SELECT {A_SQL} FROM apps WHERE NOT is_label")
add("i16_stitch_catalog", lambda t: flat(t.apps), APPS + f"SELECT {A_SQL} FROM apps")
add("i17_stitch_counts", lambda t: stitch.stitch_counts(t.apps), APPS + """SELECT count(*) FILTER (is_label) AS installomator, count(*) FILTER (NOT is_label) AS cask_only, count(*) FILTER (is_label AND token IS NOT NULL) AS both,
 count(*) FILTER (n_recipes > 0) AS autopkg_attached, count(*) FILTER (i_title IS NOT NULL) AS installer_attached, count(*) AS total FROM apps""")

# --- catalog: questions ----------------------------------------------------------------------------

add("j01_list_apps", lambda t: flat(catalog.list_apps(t.apps, vendor="s%", source="homebrew_cask", exclude_source="autopkg", limit=50, offset=5)), APPS + f"SELECT {A_SQL} FROM apps WHERE vendor ILIKE 's%' AND list_contains(src, 'homebrew_cask') AND NOT list_contains(src, 'autopkg') ORDER BY slug LIMIT 50 OFFSET 5")
add("j02_search_apps", lambda t: flat(catalog.search_apps(t.apps, "CASK-1", 60)), APPS + f"SELECT {A_SQL} FROM apps WHERE slug ILIKE '%cask-1%' OR name ILIKE '%cask-1%' OR vendor ILIKE '%cask-1%' OR bundle_id ILIKE '%cask-1%' ORDER BY slug LIMIT 60")


def _indexed_search(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "search")
    apps = storage.saved(t.apps, "apps")
    search.write_search_index(apps, path, 16)
    return flat(search.search_indexed(apps, path, "CASK-1", 60))


def _page(t: Tables) -> DataFrame:
    path = storage.shared_path(t.spark, "catalog")
    search.write_catalog(t.apps, path, 16)
    return flat(search.page_after(t.spark, path, "app3", 50, vendor="s%", source="homebrew_cask"))


add("j02_search_indexed", _indexed_search, QUERIES["j02_search_apps"][1])
add("j01_page_after", _page, APPS + f"SELECT {A_SQL} FROM apps WHERE slug > 'app3' AND vendor ILIKE 's%' AND list_contains(src, 'homebrew_cask') ORDER BY slug LIMIT 50")
add("j03_get_app", lambda t: flat(catalog.get_app(t.apps, "app6")), APPS + f"SELECT {A_SQL} FROM apps WHERE slug = 'app6'")
add("j03_get_app_sources", lambda t: catalog.get_app_sources(t.apps, t.labels.where("ord % 4 = 0").select(F.col("name").alias("slug"))).select("slug", F.col("cask_detail.token").alias("token"), F.col("installer_detail.title").alias("title")), APPS + "SELECT slug, token, i_title AS title FROM apps JOIN label_rows l ON l.name = slug WHERE ord % 4 = 0")
add("j04_catalog_summary", lambda t: catalog.catalog_summary(t.apps), APPS + "SELECT count(*) AS total, count(*) FILTER (is_label) AS installomator, count(token) AS homebrew_cask, count(n_recipes) AS autopkg, count(i_title) AS jamf_app_installer FROM apps")
add("j05_catalog_last_refresh", lambda t: catalog.catalog_last_refresh(t.labels, t.casks, t.recipes, t.installers), APPS + "SELECT max(m) AS last_refresh FROM (SELECT max(ingested_at) AS m FROM label_rows UNION ALL SELECT max(ingested_at) FROM cask_rows UNION ALL SELECT max(ingested_at) FROM recipe_rows UNION ALL SELECT max(ingested_at) FROM installer_rows)")
add("j06_catalog_last_mutation", lambda t: catalog.catalog_last_mutation(t.labels.withColumn("resolved_at", F.when(F.col("ord") % 9 == 0, F.col("ingested_at") + F.make_dt_interval(F.lit(30)))), t.casks, t.recipes, t.installers), "SELECT TIMESTAMP '2024-01-31 04:00:00' AS last_mutation FROM (SELECT count(*) FROM part)")
add("j07_catalog_categories", lambda t: catalog.catalog_categories(t.apps).select(*(F.array_join(c, ",").alias(c) for c in ("sources", "vendors", "install_methods"))),
    APPS + "SELECT (SELECT array_to_string(list_sort(list(DISTINCT s)), ',') FROM (SELECT unnest(src) AS s FROM apps)) AS sources, array_to_string(list_sort(list(DISTINCT vendor)), ',') AS vendors, 'dmg,pkg,zip,tbz,pkgInDmg,pkgInZip,appInDmgInZip' AS install_methods FROM apps")
add("j08_recent_changes", lambda t: catalog.recent_changes(t.labels.select(F.col("ord").alias("id"), "name"), 40), cte("label_rows") + "SELECT ord AS id, name FROM label_rows ORDER BY ord DESC LIMIT 40")
add("j09_code_index", lambda t: catalog.code_index(t.apps, t.standin("catalog_title_rows")).select("code", F.array_join("slugs", " ").alias("slugs")),
    APPS.rstrip() + f",\nct AS ({SQL['catalog_title_rows']})\nSELECT code, array_to_string(list_sort(list(DISTINCT slug)), ' ') AS slugs FROM (SELECT jamf_id AS code, slug FROM apps WHERE jamf_id <> '' UNION ALL SELECT name_id, slug FROM apps JOIN ct ON {norm('app_name')} = key) GROUP BY 1")
DRIFT = APPS.rstrip() + """,
vs AS (SELECT slug, name, vendor, CASE WHEN is_label AND app_new_version NOT LIKE '%$%' THEN app_new_version END AS lv, CASE WHEN c_version <> 'latest' THEN c_version END AS cv FROM apps),
dr AS (SELECT *, list_resize(list_transform(string_split(lv, '.'), lambda p: CAST(p AS BIGINT)), 4, 0) AS ka, list_resize(list_transform(string_split(cv, '.'), lambda p: CAST(p AS BIGINT)), 4, 0) AS kb FROM vs)
"""
add("j10_extract_versions", lambda t: catalog.extract_versions(t.apps).select("slug", F.array_join(F.transform("versions", lambda v: F.concat(v["source"], F.lit("="), v["version"])), ",").alias("versions")),
    DRIFT + "SELECT slug, concat_ws(',', 'installomator=' || lv, 'homebrew_cask=' || cv) AS versions FROM vs")
add("j11_parse_version", lambda t: t.table("part").select("p_partkey", F.concat("p_size", F.lit("."), F.col("p_partkey") % 10, F.lit(".0")).alias("a"), F.concat(F.col("p_partkey") % 50, F.lit("."), F.col("p_partkey") % 7).alias("b")).select("p_partkey", (parse_version(F.col("a")) < parse_version(F.col("b"))).alias("less"), (parse_version(F.col("a")) == parse_version(F.col("b"))).alias("equal")),
    "SELECT p_partkey, (CAST(p_size AS BIGINT), p_partkey % 10) < (p_partkey % 50, p_partkey % 7) AS less, CAST(p_size AS BIGINT) = p_partkey % 50 AND p_partkey % 10 = p_partkey % 7 AS equal FROM part")
_D = "CASE WHEN ka > kb THEN 'installomator' ELSE 'homebrew_cask' END AS leader, CASE WHEN ka > kb THEN 'homebrew_cask' ELSE 'installomator' END AS laggard"
add("j12_detect_drift", lambda t: catalog.detect_drift(t.apps).select("slug", "leader", "laggard"), DRIFT + f"SELECT slug, {_D} FROM dr WHERE ka <> kb")
add("j13_scan_drift", lambda t: catalog.scan_drift(t.apps, vendor="s%", source="installomator", limit=30, offset=2)[0].select("slug", "leader", "laggard"), DRIFT + f"SELECT slug, {_D} FROM dr WHERE ka <> kb AND vendor ILIKE 's%' ORDER BY slug LIMIT 30 OFFSET 2")
add("j13_scan_totals", lambda t: catalog.scan_drift(t.apps)[1], DRIFT + "SELECT count(*) AS total_scanned, count(*) FILTER (ka <> kb) AS total_with_drift FROM dr WHERE lv IS NOT NULL AND cv IS NOT NULL")
add("j14_app_drift", lambda t: catalog.app_drift(t.apps, "app12").select("slug", "leader", "laggard"), DRIFT + f"SELECT slug, {_D} FROM dr WHERE ka <> kb AND slug = 'app12'")
_pick = lambda k: F.try_element_at("content", F.lit(k)).alias(k)
_GUESS = "CASE WHEN lower(coalesce(c_url, download_url)) LIKE '%.dmg' THEN 'dmg' WHEN lower(coalesce(c_url, download_url)) LIKE '%.pkg' THEN 'pkg' WHEN lower(coalesce(c_url, download_url)) LIKE '%.tar.bz2' THEN 'tbz' END"
GEN = APPS.rstrip() + f""",
g AS (SELECT slug, coalesce(c_name, i_title, name) AS g_name, coalesce(install_type, install_method, {_GUESS}, 'dmg') AS g_type,
 coalesce(c_url, CASE WHEN l_url NOT LIKE '$(%' THEN l_url END, CASE WHEN i_source = 'External' THEN i_url END, download_url) AS g_url, current_version AS g_version, bundle_id AS g_bundle, expected_team_id AS g_team,
 concat_ws(',', CASE WHEN is_label THEN 'installomator' END, CASE WHEN token IS NOT NULL THEN 'homebrew_cask' END, CASE WHEN i_title IS NOT NULL THEN 'jamf_app_installer' END) AS used,
 coalesce(install_type, install_method) IS NULL AS guessed FROM apps)
"""
add("j15_generate_labels", lambda t: labels.generate_labels(t.apps).select("slug", *(_pick(k) for k in ("name", "type", "downloadURL", "appNewVersion", "packageID", "expectedTeamID")), F.array_join("sources_used", ",").alias("used"), F.size("warnings").cast("long").alias("warnings")),
    GEN + """SELECT slug, g_name AS name, g_type AS type, g_url AS "downloadURL", g_version AS "appNewVersion", g_bundle AS "packageID", g_team AS "expectedTeamID", used,
 CAST(guessed AS BIGINT) + CAST(g_url IS NULL AS BIGINT) + CAST(g_team IS NULL AS BIGINT) + CAST(g_version IS NULL AS BIGINT) AS warnings FROM g""")  # fmt: skip
_Q = lambda c: f"CASE WHEN regexp_full_match({c}, '[A-Za-z0-9_@%+=:,./-]+') THEN {c} ELSE '''' || replace({c}, '''', '''\"''\"''') || '''' END"
add("j16_label_readiness", lambda t: labels.label_readiness(labels.generate_labels(t.apps)).select("slug", F.array_join("missing", ",").alias("missing"), "arguments"),
    GEN + f"""SELECT slug, concat_ws(',', CASE WHEN g_url IS NULL THEN 'downloadURL' END, CASE WHEN g_team IS NULL THEN 'expectedTeamID' END) AS missing,
 concat_ws(' ', 'appNewVersion=' || {_Q('g_version')}, 'downloadURL=' || {_Q('g_url')}, 'expectedTeamID=' || {_Q('g_team')}, 'name=' || {_Q('g_name')}, 'packageID=' || {_Q('g_bundle')}, 'type=' || {_Q('g_type')}) AS arguments FROM g""")  # fmt: skip

# --- matching --------------------------------------------------------------------------------------

_names = lambda t: t.standin("title_app_names")
_slugs = lambda t: t.labels.select(F.col("name").alias("slug"))
MATCH = cte("title_app_names", "label_rows").rstrip() + f""",
{TITLES},
m AS (SELECT title_id, min(2 * pos + kind) AS pos, slug FROM (SELECT title_id, pos, 0 AS kind, lower(app_name) AS slug FROM title_app_names UNION ALL SELECT title_id, pos, 1, {norm("app_name")} FROM title_app_names) n
 WHERE slug IN (SELECT name FROM label_rows) GROUP BY title_id, slug)
"""


def fuzzy_sql(names: str, slugs: str, tag: str, threshold: float = 85) -> str:
    """CTEs that end in ``best_<tag>`` (name, slug, ratio): every pair of names and slugs, cut down by the edit distance, by a common subsequence of bit rows (names of up to 120 characters)."""
    t = threshold / 100
    mask = "list_sum(list_transform(range(length(name)), lambda i: CASE WHEN name[CAST(i AS INT) + 1] = slug[CAST(j AS INT)] THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END))"
    full = "((1::HUGEINT << length(name)) - 1)"
    return f"""near_{tag} AS (SELECT name, slug FROM (SELECT DISTINCT name FROM ({names})) a JOIN (SELECT DISTINCT slug FROM ({slugs})) b
 ON 2 * least(length(name), length(slug)) >= {t} * (length(name) + length(slug)) - 1e-9 AND levenshtein(name, slug) <= {1 - t} * (length(name) + length(slug)) + 1e-9),
hits_{tag} AS (SELECT name, slug, list_transform(range(1, length(slug) + 1), lambda j: CAST({mask} AS HUGEINT)) AS hits FROM near_{tag}),
rows_{tag} AS (SELECT name, slug, list_reduce(hits, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full}) AS bits FROM hits_{tag}),
best_{tag} AS (SELECT name, slug, 200.0::DOUBLE * (length(name) - bit_count(bits)) / (length(name) + length(slug)) AS ratio FROM rows_{tag} WHERE ratio >= {threshold} QUALIFY row_number() OVER (PARTITION BY name ORDER BY ratio DESC, slug) = 1)"""


add("f01_normalize_name", lambda t: t.table("part").select("p_partkey", x.normalize_name(F.concat("p_name", F.lit(" - (É) "), "p_brand")).alias("key")), "SELECT p_partkey, regexp_replace(lower(p_name || ' - (É) ' || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part")
add("f02_drop_ignored", lambda t: matching.drop_ignored(t.titles, ["a*ue *", "?l* 1[0-4]*", "*[!0-8]"]).select("title_id"), f"WITH {TITLES}\nSELECT title_id FROM titles WHERE NOT (title GLOB 'a*ue *' OR title GLOB '?l* 1[0-4]*' OR title GLOB '*[!0-8]' OR title GLOB 'Adobe *' OR title GLOB 'Jamf *' OR title GLOB 'Apple macOS *')")
add("f03_match_by_code", lambda t: matching.match_by_code(t.titles, t.labels.selectExpr("upper(hex(ord % 100)) AS code", "name").groupBy("code").agg(F.array_sort(F.collect_list("name")).alias("slugs")), _slugs(t).where("slug not like '%9'")).select("title_id", "slug"),
    MATCH + "SELECT title_id, name AS slug FROM titles JOIN label_rows ON name_id = upper(hex(ord % 100)) WHERE name NOT LIKE '%9'")
add("f04_match_direct", lambda t: matching.match_direct(_names(t), _slugs(t)), MATCH + "SELECT title_id, pos, slug FROM m")
add("f05_match_fuzzy", lambda t: matching.match_fuzzy(_names(t), _slugs(t)),
    MATCH.rstrip() + ",\n" + fuzzy_sql("SELECT lower(app_name) AS name FROM title_app_names", "SELECT name AS slug FROM label_rows", "n") + "\nSELECT title_id, min(pos) AS pos, slug FROM title_app_names JOIN best_n ON name = lower(app_name) GROUP BY title_id, slug")
_NAMED = f"SELECT title_id, {norm('title')} AS name FROM titles"
add("f06_second_pass", lambda t: matching.second_pass(t.titles, t.casks.select(x.normalize_name("name").alias("slug"))),
    MATCH.rstrip() + f",\ns AS (SELECT DISTINCT {norm('name')} AS slug FROM ({SQL['cask_rows']})),\nd AS ({_NAMED}),\n" + fuzzy_sql("SELECT name FROM d WHERE name NOT IN (SELECT slug FROM s)", "SELECT slug FROM s", "t") + """
SELECT title_id, 0 AS pos, name AS slug FROM d WHERE name <> '' AND name IN (SELECT slug FROM s) UNION ALL SELECT title_id, 0, slug FROM d JOIN best_t USING (name) WHERE name <> ''""")  # fmt: skip
add("f07_attach_sources", lambda t: matching.attach_sources(matching.match_direct(_names(t), _slugs(t)), t.apps, ["installomator", "homebrew_cask"]).select("title_id", F.explode("sources").alias("source", "slugs")).select("title_id", "source", F.array_join("slugs", " ").alias("slugs")),
    APPS.rstrip() + ",\n" + MATCH.removeprefix("WITH ").replace(f"label_rows AS ({SQL['label_rows']}),\n", "").rstrip() + "\nSELECT title_id, s.source, string_agg(slug, ' ' ORDER BY pos) AS slugs FROM m JOIN (SELECT slug, unnest(src) AS source FROM apps) s USING (slug) WHERE s.source IN ('installomator', 'homebrew_cask') GROUP BY ALL")
add("f08_enrich_native_ids", lambda t: matching.enrich_native_ids(matching.attach_sources(matching.match_direct(_names(t), _slugs(t)), t.apps), t.apps).select("title_id", F.explode("sources").alias("source", "names")).select("title_id", "source", F.array_join(F.array_sort("names"), "|").alias("names")),
    APPS.rstrip() + ",\n" + MATCH.removeprefix("WITH ").replace(f"label_rows AS ({SQL['label_rows']}),\n", "").rstrip() + """
SELECT title_id, s.source, CASE s.source WHEN 'autopkg' THEN max(repos) WHEN 'jamf_app_installer' THEN max(i_title) ELSE array_to_string(list_sort(list(slug)), '|') END AS names
 FROM m JOIN (SELECT slug, repos, i_title, unnest(src) AS source FROM apps) s USING (slug) GROUP BY title_id, s.source""")  # fmt: skip
add("f09_unmatched", lambda t: matching.unmatched(t.titles, _names(t), matching.match_direct(_names(t), _slugs(t))).select("title_id", F.array_join("app_names", "|").alias("app_names")),
    MATCH + "SELECT title_id, coalesce(app_name, '') AS app_names FROM titles LEFT JOIN title_app_names USING (title_id) WHERE title_id NOT IN (SELECT title_id FROM m)")
add("f10_match_titles", lambda t: matching.match_titles(t.titles, _names(t), t.apps, catalog.code_index(t.apps, t.standin("catalog_title_rows"))),
    APPS.rstrip() + ",\n" + MATCH.removeprefix("WITH ").replace(f"label_rows AS ({SQL['label_rows']}),\n", "").rsplit("m AS", 1)[0].rstrip() + f"""
c AS (SELECT DISTINCT slug FROM apps WHERE list_contains(src, 'installomator') OR list_contains(src, 'homebrew_cask')),
live AS (SELECT * FROM titles WHERE NOT ({' OR '.join(f"title GLOB '{g}'" for g in matching.IGNORED_TITLES)})),
ct AS ({SQL['catalog_title_rows']}),
codes AS (SELECT code, slug, CAST(row_number() OVER (PARTITION BY code ORDER BY slug) - 1 AS INT) AS pos FROM (SELECT jamf_id AS code, slug FROM apps WHERE jamf_id <> '' UNION SELECT ct.name_id, slug FROM apps JOIN ct ON {norm('app_name')} = key)),
by_code AS (SELECT title_id, 'code' AS step, pos, slug FROM live JOIN codes ON code = live.name_id WHERE slug IN (SELECT slug FROM c)),
n1 AS (SELECT * FROM title_app_names WHERE title_id IN (SELECT title_id FROM live) AND title_id NOT IN (SELECT title_id FROM by_code)),
direct AS (SELECT title_id, 'direct' AS step, min(2 * pos + kind) AS pos, slug FROM (SELECT title_id, pos, 0 AS kind, lower(app_name) AS slug FROM n1 UNION ALL SELECT title_id, pos, 1, {norm("app_name")} FROM n1) WHERE slug IN (SELECT slug FROM c) GROUP BY title_id, slug),
n2 AS (SELECT * FROM n1 WHERE title_id NOT IN (SELECT title_id FROM direct)),
""" + fuzzy_sql("SELECT lower(app_name) AS name FROM n2", "SELECT slug FROM c", "n") + """,
fuzzy AS (SELECT title_id, 'fuzzy' AS step, min(pos) AS pos, slug FROM n2 JOIN best_n ON name = lower(app_name) GROUP BY title_id, slug),
d AS (""" + _NAMED.replace("FROM titles", "FROM live") + """ WHERE title_id NOT IN (SELECT title_id FROM by_code UNION SELECT title_id FROM direct UNION SELECT title_id FROM fuzzy)),
""" + fuzzy_sql("SELECT name FROM d WHERE name NOT IN (SELECT slug FROM c)", "SELECT slug FROM c", "t") + """
SELECT title_id, step, pos, slug FROM by_code UNION ALL SELECT title_id, step, pos, slug FROM direct UNION ALL SELECT title_id, step, pos, slug FROM fuzzy
UNION ALL SELECT title_id, 'second pass', 0, name FROM d WHERE name <> '' AND name IN (SELECT slug FROM c) UNION ALL SELECT title_id, 'second pass', 0, slug FROM d JOIN best_t USING (name) WHERE name <> ''""")  # fmt: skip
add("f11_candidate_apps", lambda t: matching.candidate_apps(t.apps, ["installomator", "autopkg"]).select("slug"), APPS + "SELECT slug FROM apps WHERE is_label")
add("h01_indel_ratio", lambda t: matching.similar_names(t.table("part").selectExpr("lower(p_name || ' ' || p_size) AS name"), t.table("part").select(x.normalize_name(F.concat("p_name", "p_size")).alias("slug")), 80.0),
    "WITH " + fuzzy_sql("SELECT lower(p_name || ' ' || p_size) AS name FROM part", f"SELECT {norm('p_name || p_size')} AS slug FROM part", "n", 80) + "\nSELECT name, slug, ratio FROM best_n")

# --- labels ----------------------------------------------------------------------------------------


def _fragments(t: Tables) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = lambda k, v: F.concat(F.lit(f"    {k}="), v, F.lit("\n"))
    text = F.concat(
        F.col("name"), F.lit(")\n    # it's a comment\n"), line("name", q(F.col("display_name"))), F.coalesce(line("type", q(F.col("install_type"))), F.lit("")), F.coalesce(line("downloadURL", F.col("download_url")), F.lit("")),
        F.coalesce(line("appNewVersion", F.when(F.col("app_new_version").startswith("$"), F.lit("$(curl -fs 'x y' |\n  head -n 1; echo \")\")")).otherwise(F.col("app_new_version"))), F.lit("")), line("appNewVersion", F.lit("second")),
        line("blockingProcesses", F.lit('( "One App" Two )')), F.coalesce(line("expectedTeamID", q(F.when(F.col("ord") % 9 == 0, "Media").otherwise(F.col("expected_team_id")))), F.lit("")), F.lit("    ;;\n"),
    )
    return t.labels.select("name", text.alias("fragment"))


add("l01_parse_fragments", lambda t: labels.parse_fragments(_fragments(t)).select("name", "key", "pos", F.array_join("value", "|").alias("value"), "is_array"),
    cte("label_rows") + """SELECT name, 'name' AS key, 0 AS pos, display_name AS value, false AS is_array FROM label_rows UNION ALL SELECT name, 'type', 0, install_type, false FROM label_rows WHERE install_type IS NOT NULL
UNION ALL SELECT name, 'downloadURL', 0, download_url, false FROM label_rows WHERE download_url IS NOT NULL
UNION ALL SELECT name, 'appNewVersion', 0, CASE WHEN app_new_version LIKE '$%' THEN '$(curl -fs ''x y'' |' || chr(10) || '  head -n 1; echo ")")' ELSE app_new_version END, false FROM label_rows WHERE app_new_version IS NOT NULL
UNION ALL SELECT name, 'appNewVersion', CASE WHEN app_new_version IS NULL THEN 0 ELSE 1 END, 'second', false FROM label_rows UNION ALL SELECT name, 'blockingProcesses', 0, 'One App|Two', true FROM label_rows
UNION ALL SELECT name, 'expectedTeamID', 0, CASE WHEN ord % 9 = 0 THEN 'Media' ELSE expected_team_id END, false FROM label_rows WHERE ord % 9 = 0 OR expected_team_id IS NOT NULL""")  # fmt: skip
add("l02_first_scalar", lambda t: labels.parse_fragments(_fragments(t)).select("name", "key", "pos", x.first_scalar("value").alias("first")).where("key = 'blockingProcesses'").select("name", "first"), cte("label_rows") + "SELECT name, 'One App' AS first FROM label_rows")
add("l03_ingest_labels", lambda t: labels.ingest_labels(labels.parse_fragments(_fragments(t)), at(AS_OF)).select("name", "display_name", "install_type", "download_url", "app_new_version", "expected_team_id"),
    cte("label_rows") + """SELECT name, display_name, install_type, CASE WHEN download_url LIKE 'http%' THEN download_url END AS download_url,
 CASE WHEN app_new_version LIKE '$%' THEN NULL ELSE app_new_version END AS app_new_version, expected_team_id FROM label_rows WHERE ord % 9 > 0""")  # fmt: skip
_VALUES = "(SELECT name, 'url' AS kind, download_url AS v FROM label_rows UNION ALL SELECT name, 'version', app_new_version FROM label_rows)"
add("l04_is_shell_expression", lambda t: t.labels.select("name", x.is_shell_expression("download_url").alias("url"), x.is_shell_expression("app_new_version").alias("version")), cte("label_rows") + "SELECT name, coalesce(download_url LIKE '$%', false) AS url, coalesce(app_new_version LIKE '$%', false) AS version FROM label_rows")
add("l05_is_clean_url", lambda t: t.table("pages").select("page_id", x.is_clean_url("url").alias("clean")), "SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS clean FROM pages")
add("l06_is_clean_version", lambda t: t.standin("resolved").select("ord", x.is_clean_version("appNewVersion").alias("clean")), cte("resolved") + "SELECT ord, appNewVersion IS NOT NULL AND appNewVersion <> '<html>' AS clean FROM resolved")
add("l07_classify_value", lambda t: labels.classified(t.labels).select("name", "kind", "status"),
    cte("label_rows") + f"SELECT name, kind, CASE WHEN v IS NULL OR v LIKE '$%' THEN 'unresolvable' WHEN kind = 'url' AND v NOT LIKE 'http%' THEN 'invalid' ELSE 'resolved' END AS status FROM {_VALUES}")


def _work(t: Tables) -> DataFrame:
    return t.labels.select(
        "name", F.col("download_url").alias("raw_url"), F.col("app_new_version").alias("raw_version"), F.when(~x.is_shell_expression("download_url"), F.col("download_url")).alias("download_url"), F.when(~x.is_shell_expression("app_new_version"), F.col("app_new_version")).alias("app_new_version"),
        F.when(F.col("ord") % 6 == 0, "macos").alias("resolution_source"), (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("ord") % 12).cast("int"))).alias("resolved_at"), (F.col("ord") % 15 == 0).alias("user_context"),
    )


_DYN = "(download_url LIKE '$%' OR app_new_version LIKE '$%')"
add("l08_needs_resolution", lambda t: labels.needs_resolution(_work(t)), cte("label_rows") + f"SELECT name FROM label_rows WHERE ord % 15 > 0 AND (ord % 6 = 0 OR coalesce({_DYN}, false))")
add("l09_refresh_candidates", lambda t: labels.refresh_candidates(_work(t), t.labels.where("ord % 5 = 1").select("name"), at(AS_OF)).select("name"), cte("label_rows") + f"SELECT name FROM label_rows WHERE coalesce({_DYN}, false) AND ord % 15 > 0 AND NOT (ord % 6 = 0 AND ord % 12 < 7) AND ord % 5 <> 1")


def _validated(t: Tables) -> DataFrame:
    good, bad = labels.validate_labels(t.labels.select(F.col("display_name").alias("name"), F.col("name").alias("label"), F.col("install_type").alias("type"), F.when(F.col("ord") % 9 == 0, "Software Update").when(F.col("ord") % 21 == 0, "short").otherwise(F.col("expected_team_id")).alias("expected_team_id")))
    return good.select("label", F.lit("").alias("errors")).union(bad.select("label", F.array_join("errors", "; ")))


add("l10_validate_labels", _validated, cte("label_rows") + "SELECT name AS label, concat_ws('; ', CASE WHEN install_type = 'exe' THEN 'type: not allowed' END, CASE WHEN ord % 9 > 0 AND ord % 21 = 0 THEN 'expected_team_id: not 10 characters' END) AS errors FROM label_rows")
add("l11_version_from_tag", lambda t: t.table("part").select("p_partkey", x.version_from_tag(F.when(F.col("p_partkey") % 4 == 0, "release").otherwise(F.concat(F.lit("v"), "p_size", F.lit("."), "p_partkey", F.lit("-rc")))).alias("version")), "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size || '.' || p_partkey END AS version FROM part")
add("l12_pick_release_asset", lambda t: t.table("part").select("p_partkey", x.pick_release_asset(F.array(F.concat(F.lit("https://e/"), "p_partkey", F.lit("-mac.dmg")), F.concat(F.lit("https://e/"), "p_partkey", F.lit("-arm.zip"))), F.when(F.col("p_partkey") % 3 == 0, "arm").when(F.col("p_partkey") % 3 == 1, "$x").otherwise("none"), F.when(F.col("p_partkey") % 2 == 0, "pkgInDmg").otherwise("zip")).alias("asset")),
    "SELECT p_partkey, 'https://e/' || p_partkey || CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 1 THEN '-arm.zip' ELSE '-mac.dmg' END AS asset FROM part")
add("l13_json_path_value", lambda t: t.table("part").select("p_partkey", F.to_json(F.struct(F.struct(F.array("p_name", "p_brand").alias("b c")).alias("a"), "p_size")).alias("j")).select("p_partkey", x.json_path_value("j", '.a["b c"][1]').alias("brand"), x.json_path_value("j", "p_size").alias("size"), x.json_path_value("j", "a.x").alias("none")),
    "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS none FROM part")

# --- reports ---------------------------------------------------------------------------------------

_BAND = "CASE WHEN completion_percent < 70 THEN 'red' WHEN completion_percent < 90 THEN 'yellow' ELSE 'green' END"
_R = f"WITH {TITLES}\n"
add("k01_fleet_summary", lambda t: reports.fleet_summary(t.titles), _R + "SELECT count(*) AS titles, round_even(avg(completion_percent), 2) AS avg_completion, count(*) FILTER (completion_percent < 70) AS below_threshold, CAST(sum(total_hosts) AS BIGINT) AS hosts, CAST(sum(hosts_patched) AS BIGINT) AS patched FROM titles")
add("k02_health_band", lambda t: t.titles.select("title_id", reports.health_band(F.col("completion_percent")).alias("band")), _R + f"SELECT title_id, {_BAND} AS band FROM titles")
add("k03_daily_summary", lambda t: reports.daily_summary(t.titles), _R + """SELECT 'tracked' AS kind, '' AS title, count(*)::DOUBLE AS value FROM titles UNION ALL SELECT 'at_least_90', '', count(*) FILTER (completion_percent >= 90) FROM titles
UNION ALL SELECT 'below_70', '', count(*) FILTER (completion_percent < 70) FROM titles UNION ALL SELECT 'worst', title, completion_percent FROM (SELECT * FROM titles ORDER BY completion_percent, title, title_id LIMIT 5)""")
add("k04_report_columns", lambda t: reports.report_columns(t.titles), _R + 'SELECT title AS "Title", released AS "Released", hosts_patched AS "Hosts Patched", missing_patch AS "Missing Patch", latest_version AS "Latest Version", total_hosts AS "Total Hosts", completion_percent AS "Completion Percent" FROM titles')
add("k05_coverage_columns", lambda t: reports.coverage_columns(t.titles).select("title_id", *reports.SOURCES.values()), _R + """SELECT title_id, CASE WHEN src IN (1, 3) THEN 'Y' ELSE 'N' END AS "Installomator", CASE WHEN src IN (2, 3) THEN 'Y' ELSE 'N' END AS "Homebrew", 'N' AS "AutoPkg", 'N' AS "Jamf App Installers" FROM titles""")
add("k06_device_detail", lambda t: reports.device_detail(hydrate.device_rows(_device_source(t)), t.titles.where("cast(title_id as int) % 5 > 0")).select("device_id", "sheet", "last_contact", "building_name"),
    cte("devices").rstrip() + f",\n{TITLES}\nSELECT device_id, substr(translate(coalesce(title, 'Title_' || title_id), ':\\/?*[]', ''), 1, 31) AS sheet, strftime(last_contact_time, '%Y-%m-%d %H:%M:%S') AS last_contact, building_name FROM devices LEFT JOIN (SELECT title, title_id FROM titles WHERE CAST(title_id AS INT) % 5 > 0) USING (title_id)")
add("k07_log_events", lambda t: reports.log_events(t.titles, at(AS_OF)).select("message", "ts", "title_id"), _R + f"SELECT title || ' at ' || printf('%.1f', round_even(completion_percent, 1)) || '%' AS message, TIMESTAMP '{AS_OF}' AS ts, title_id FROM titles")
add("k08_diff_report", lambda t: reports.diff_report(diff.changed(*_pair(t))), PAIR + f"SELECT title_id, title, {PCT.format('from_completion_percent')} || ' → ' || {PCT.format('to_completion_percent')} AS completion, from_total_hosts || ' → ' || to_total_hosts AS hosts, CASE WHEN version_changed THEN from_latest_version || ' → ' || to_latest_version || ' (bump)' ELSE to_latest_version END AS version FROM ch")
add("k09_analysis_table", lambda t: reports.analysis_table(t.titles), _R + f"SELECT title, released, hosts_patched, missing_patch, total_hosts, completion_percent, {_BAND} AS health, CASE WHEN src IN (1, 3) THEN 'Y' ELSE 'N' END AS label FROM titles")
add("k10_drift_report", lambda t: reports.drift_report(catalog.detect_drift(t.apps)), DRIFT + "SELECT slug, name, 'installomator=' || lv || ', homebrew_cask=' || cv AS versions, CASE WHEN ka > kb THEN 'installomator' ELSE 'homebrew_cask' END AS leader FROM dr WHERE ka <> kb")

# --- lines -----------------------------------------------------------------------------------------

LINES = "WITH lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents, range(1, len(string_split(text, chr(10))) + 1) t(i))\n"


def l_query(name: str, plan: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda t: plan(lines.to_lines(t.table("documents"))), LINES + sql)


l_query("t01_to_lines", lambda df: df, "SELECT doc_id, line_no, line FROM lines")
add("t01_from_lines", lambda t: lines.from_lines(lines.to_lines(t.table("documents"))), "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
l_query("t02_grep", lambda df: lines.grep(df, "license|the [a-f]+ing", ignore_case=True), "SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)license|the [a-f]+ing')")
l_query("t02_grep_only", lambda df: lines.grep(df, "[0-9]{3,}", only=True, every=True), "SELECT doc_id, line_no, CAST(generate_subscripts(m, 1) - 1 AS INT) AS match_no, unnest(m) AS line FROM (SELECT *, regexp_extract_all(line, '[0-9]{3,}') AS m FROM lines)")
l_query("t02_grep_first", lambda df: lines.grep(df, "[0-9]+|the", only=True), "SELECT doc_id, line_no, regexp_extract(line, '[0-9]+|the') AS line FROM lines WHERE regexp_matches(line, '[0-9]+|the')")
l_query("t02_grep_invert", lambda df: lines.grep(df, "e", invert=True), "SELECT doc_id, line_no, line FROM lines WHERE line NOT LIKE '%e%'")
l_query("t03_head", lambda df: lines.head(df, 3), "SELECT doc_id, line_no, line FROM lines WHERE line_no <= 3")
l_query("t03_tail", lambda df: lines.tail(df, 2), "SELECT doc_id, line_no, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 2")
l_query("t04_cut", lambda df: lines.cut(df, " ", "2,4-5,8-", posix=True), "SELECT doc_id, line_no, CASE WHEN line LIKE '% %' THEN array_to_string(list_filter(string_split(line, ' '), lambda w, i: i = 2 OR i IN (4, 5) OR i >= 8), ' ') ELSE line END AS line FROM lines")
l_query("t04_cut_asked_order", lambda df: lines.cut(df, " ", "3,1-2,3"), "SELECT doc_id, line_no, array_to_string(list_filter([w[3], w[1], w[2], w[3]], lambda x: x IS NOT NULL), ' ') AS line FROM (SELECT *, string_split(line, ' ') AS w FROM lines)")
l_query("t05_awk_field", lambda df: lines.awk_field(df, 3), "SELECT doc_id, line_no, coalesce(string_split(trim(regexp_replace(line, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), ' ')[3], '') AS line FROM lines")
l_query("t06_sed_first", lambda df: lines.sed_sub(df, "([a-z]+)ing", r"<\1>&$"), "SELECT doc_id, line_no, regexp_replace(line, '([a-z]+)ing', '<\\1>\\0$') AS line FROM lines")
l_query("t06_sed_all", lambda df: lines.sed_sub(df, "([aeiou])([rst])", r"\2\1", all_matches=True), "SELECT doc_id, line_no, regexp_replace(line, '([aeiou])([rst])', '\\2\\1', 'g') AS line FROM lines")
l_query("t07_tr", lambda df: lines.tr(df, "abc.", "xyz!"), "SELECT doc_id, line_no, translate(line, 'abc.', 'xyz!') AS line FROM lines")
l_query("t07_tr_delete", lambda df: lines.tr_delete(df, "aeiou"), "SELECT doc_id, line_no, translate(line, 'aeiou', '') AS line FROM lines")
l_query("t08_sort_lines", lambda df: lines.sort_lines(df), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line COLLATE \"C\", line_no) AS INT) AS line_no, line FROM lines")
l_query("t08_sort_numeric", lambda df: lines.sort_lines(lines.awk_field(df, 2), reverse=True, numeric=True), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n IS NULL DESC, n DESC NULLS LAST, line DESC, line_no) AS INT) AS line_no, line FROM (SELECT *, try_cast(trim(line) AS DOUBLE) AS n FROM (SELECT doc_id, line_no, coalesce(string_split(trim(regexp_replace(line, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), ' ')[2], '') AS line FROM lines))")
l_query("t09_uniq", lambda df: lines.uniq(lines.sort_lines(df)).select("doc_id", "line"), "SELECT DISTINCT doc_id, line FROM lines")
add("t08_sort_ranged", lambda t: lines.sort_lines(lines.to_lines(t.table("documents")), ranged=True), QUERIES["t08_sort_lines"][1])
add("t09_uniq_ranged", lambda t: lines.uniq(lines.sort_lines(lines.to_lines(t.table("documents")), ranged=True), ranged=True).select("doc_id", "line"), QUERIES["t09_uniq"][1])
add("t10_xpath_values", lambda t: lines.xpath_values(t.table("part").select("p_partkey", F.concat(F.lit('<a xmlns:s="u">'), F.expr("replace('<i s:v=\"V\">N</i><i s:v=\"W\">M</i>', 'V', p_brand)"), F.when(F.col("p_partkey") % 5 > 0, "</a>").otherwise("")).alias("xml")), '/a/i/@*[name()="s:v"]').select("p_partkey", "value"),
    "SELECT p_partkey, 's:v=\"' || unnest([p_brand, 'W']) || '\"' AS value FROM part WHERE p_partkey % 5 > 0")

# --- composed jobs ---------------------------------------------------------------------------------


def flagship(t: Tables) -> DataFrame:
    """Catalog build to answer: the apps whose sources disagree on the version."""
    return catalog.detect_drift(t.apps).select("slug", "name", "vendor", "leader", "laggard").orderBy("slug")


add("flagship_catalog_drift", flagship, DRIFT + f"SELECT slug, name, vendor, {_D} FROM dr WHERE ka <> kb")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, (plan, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
