"""Title, snapshot and catalog rows derived from the driver's tables, as Spark frames and as SQL for the oracle.

The SQL is DuckDB's; ``Tables`` runs the same text on Spark after a few function names are replaced.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "titles_raw": """
SELECT p_name || ' ' || p_partkey AS title, CAST(p_partkey AS VARCHAR) AS title_id, strftime(max(l_shipdate), '%b %d %Y') AS released,
 count(*) FILTER (WHERE l_quantity <= (p_partkey % 11) * 5) AS hosts_patched, count(*) FILTER (WHERE l_quantity > (p_partkey % 11) * 5) AS missing_patch,
 p_size || '.' || (p_partkey % 10) || '.0' AS latest_version, upper(hex(p_partkey % 500)) AS name_id, p_partkey % 4 AS src
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_partkey, p_size""",
    "snapshots_raw": """
SELECT make_timestamp(y, 12, 31, 12, 0, 0) AS snapshot_ts, title, title_id, strftime(min(l_shipdate), '%b %d %Y') AS released,
 count(*) FILTER (WHERE l_quantity <= cut) AS hosts_patched, count(*) FILTER (WHERE l_quantity > cut) AS missing_patch, latest_version
FROM (SELECT *, year(l_shipdate) AS y, p_name || ' ' || p_partkey AS title, CAST(p_partkey AS VARCHAR) AS title_id,
  p_size || '.' || (year(l_shipdate) % (1 + p_partkey % 3)) AS latest_version,
  CASE p_partkey % 11 WHEN 0 THEN 0 WHEN 10 THEN 50 ELSE (p_partkey % 11) * 5 + (year(l_shipdate) - 1995) * 2 END AS cut
  FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY y, title, title_id, latest_version""",
    "devices": """
SELECT CAST(l_partkey AS VARCHAR) AS title_id, c_name AS computer_name, l_orderkey || '-' || l_linenumber AS device_id, 'user' || c_custkey AS username,
 (10 + c_nationkey % 8) || '.' || (c_custkey % 7) AS operating_system_version, CAST(o_orderdate AS TIMESTAMP) AS last_contact_time,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS building_name, o_orderpriority AS department_name, n_name AS site_name, CAST(l_quantity AS BIGINT) || '.0' AS version
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "label_rows": """
SELECT p_partkey AS ord, 'app' || p_partkey AS name, p_name || ' ' || p_partkey AS display_name,
 CASE p_partkey % 5 WHEN 0 THEN 'dmg' WHEN 1 THEN 'pkg' WHEN 2 THEN 'zip' WHEN 3 THEN 'exe' END AS install_type,
 CASE WHEN p_partkey % 6 = 0 THEN 'com.' || lower(p_type) || '.' || p_partkey END AS package_id,
 CASE p_partkey % 4 WHEN 0 THEN 'https://dl.example.com/' || p_partkey || '.dmg' WHEN 1 THEN '$(curl -fs https://e.example)' WHEN 2 THEN 'ftp://e.example/' || p_partkey END AS download_url,
 CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || (p_partkey % 3) WHEN 1 THEN '${v}' WHEN 2 THEN p_size || '.' || (p_partkey % 10) || '.0' END AS app_new_version,
 CASE WHEN p_partkey % 7 <> 0 THEN 'TEAM' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') END AS expected_team_id, TIMESTAMP '2024-01-01 04:00:00' AS ingested_at
FROM part WHERE p_partkey % 3 = 0""",
    "cask_rows": """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'app' || p_partkey ELSE 'cask-' || p_partkey END AS token,
 p_name || ' ' || p_partkey AS name, p_name || ' ' || p_partkey || '.app' AS app_artifact,
 'https://cdn.example.com/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.DMG' WHEN 1 THEN '.pkg' ELSE '.tar.bz2' END AS url,
 CASE WHEN p_partkey % 11 = 0 THEN 'latest' ELSE p_size || '.' || (p_partkey % 10) END AS version, 'no_check' AS sha256, TIMESTAMP '2024-01-02 04:00:00' AS ingested_at
FROM part WHERE p_partkey % 2 = 0""",
    "recipe_rows": """
SELECT DISTINCT 'com.sup' || l_suppkey || '.' || l_partkey AS identifier, replace(p_name, ' ', '') || l_partkey AS name, 'sup' || l_suppkey || '/recipes' AS repo,
 p_brand || '/' || l_partkey || '.recipe' AS path, 'download' AS inferred_type, TIMESTAMP '2024-01-03 04:00:00' AS ingested_at
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 2 = 1""",
    "installer_rows": """
SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'Adobe ' ELSE '' END || p_name || ' ' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN ' Pro' ELSE '' END AS title,
 CASE WHEN p_partkey % 4 = 0 THEN 'Jamf' ELSE 'External' END AS source, CASE WHEN p_partkey % 10 = 0 THEN 'com.' || lower(p_type) || '.' || p_partkey END AS bundle_id,
 p_size || '.9' AS version, upper(hex(p_partkey)) AS jamf_id, 'https://vendor.example.org/' || p_partkey || '.pkg' AS download_url, TIMESTAMP '2024-01-04 04:00:00' AS ingested_at
FROM part WHERE p_partkey % 5 = 0""",
    "catalog_title_rows": """
SELECT 'T' || p_partkey AS name_id, upper(p_name) || '-' || p_partkey AS app_name, p_brand AS publisher, p_size || '.0' AS current_version, TIMESTAMP '2024-02-01 00:00:00' AS last_modified
FROM part WHERE p_partkey % 4 = 1""",
    "title_app_names": """
SELECT CAST(p_partkey AS VARCHAR) AS title_id, 0 AS pos, CASE p_partkey % 3 WHEN 0 THEN 'App' || p_partkey WHEN 1 THEN 'App ' || p_partkey ELSE 'Ap' || p_partkey || ' ' || p_name END AS app_name
FROM part WHERE p_partkey % 8 <> 0""",
    "ios_devices": """
SELECT user_id, (15 + user_id % 4) || '.' || (event_id % 6) || '.1' AS os_version FROM events""",
    "resolved": """
SELECT event_id AS ord, 'app' || (event_id % 300) AS label, event_type <> 'error' AS ok,
 CASE WHEN event_type = 'click' THEN 'ftp://x' ELSE 'https://dl.example.com/' || user_id || '.dmg?a=1&amp;b=2' END AS downloadURL,
 CASE WHEN event_type = 'view' THEN '<html>' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS appNewVersion FROM events""",
}
_SPARK = (("strftime(max(l_shipdate), '%b %d %Y')", "date_format(max(l_shipdate), 'MMM dd yyyy')"), ("strftime(min(l_shipdate), '%b %d %Y')", "date_format(min(l_shipdate), 'MMM dd yyyy')"), ("AS VARCHAR", "AS STRING"))


class Tables:
    """The driver's tables and the stand-ins of one folder, as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def standin(self, name: str) -> DataFrame:
        text = SQL[name]
        for a, b in _SPARK:
            text = text.replace(a, b)
        used = {t: self.table(t) for t in ("lineitem", "part", "orders", "customer", "nation", "events")}
        for t in used:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {t}\n", f"{word} {{{t}}}\n").replace(f"{word} {t} ", f"{word} {{{t}}} ")
            if text.endswith(f"FROM {t}"):
                text = text.removesuffix(t) + f"{{{t}}}"
        text = text.replace("'${v}'", "concat('$', '{{v}}')")
        return self.spark.sql(text, **{t: df for t, df in used.items() if f"{{{t}}}" in text})

    @cached_property
    def titles(self) -> DataFrame:
        from pyspark.sql import functions as F

        from ..sources.titles import derive_title_metrics

        token = lambda k, t: F.when(F.col("src").isin(*k), F.struct(F.lit(t).alias("k"), F.array(F.concat(F.lit("app"), "title_id")).alias("v")))
        sources = F.map_from_entries(F.array_compact(F.array(token((1, 3), "installomator"), token((2, 3), "homebrew_cask"))))
        return derive_title_metrics(self.standin("titles_raw").withColumn("sources", sources).drop("src"))

    @cached_property
    def snapshots(self) -> DataFrame:
        from ..sources.titles import derive_title_metrics

        return derive_title_metrics(self.standin("snapshots_raw"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.standin("label_rows")

    @cached_property
    def casks(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.standin("cask_rows").withColumn("artifacts", F.array(F.struct(F.array("app_artifact").alias("app"))))

    @cached_property
    def recipes(self) -> DataFrame:
        return self.standin("recipe_rows")

    @cached_property
    def installers(self) -> DataFrame:
        return self.standin("installer_rows")

    @cached_property
    def apps(self) -> DataFrame:
        from ..operators.stitch import stitch_catalog

        return stitch_catalog(self.labels, self.casks, self.recipes, self.installers)


TITLES = f"""titles_raw AS ({SQL["titles_raw"]}),
titles AS (SELECT *, hosts_patched + missing_patch AS total_hosts,
 CASE WHEN hosts_patched + missing_patch > 0 THEN round_even(hosts_patched * 100.0::DOUBLE / (hosts_patched + missing_patch), 2) ELSE 0.0 END AS completion_percent,
 try_strptime(released, '%b %d %Y') AS day FROM titles_raw)"""
SNAPSHOTS = f"""snapshots_raw AS ({SQL["snapshots_raw"]}),
snaps AS (SELECT *, hosts_patched + missing_patch AS total_hosts,
 CASE WHEN hosts_patched + missing_patch > 0 THEN round_even(hosts_patched * 100.0::DOUBLE / (hosts_patched + missing_patch), 2) ELSE 0.0 END AS completion_percent,
 try_strptime(released, '%b %d %Y') AS day FROM snapshots_raw)"""
