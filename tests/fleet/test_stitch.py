"""Apps that lack a cask, a bundle id or an installer are most of a catalog; no task may get them all."""

from pyspark.sql import functions as F

from fleetlake.operators import catalog, stitch
from fleetlake.sources.storage import left_join_spread


def test_rows_without_a_key_are_dealt_and_meet_nothing(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    left = spark.range(4000).select(F.concat(F.lit("app"), "id").alias("slug"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("k"), F.col("id") % 16)).alias("key"))
    right = spark.createDataFrame([("k0", 1), ("k0", 2), ("\0app1", 3), (None, 4)], "key string, v int")
    out = left_join_spread(left, right.hint("merge"), "key", "slug")
    want = left.join(right, "key", "left")
    assert out.columns == ["slug", "key", "v"] and sorted(map(repr, out.select("key", "slug", "v").collect())) == sorted(map(repr, want.select("key", "slug", "v").collect()))
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in sizes) < 2000


def test_payload_joins_keep_no_null_keys_together(spark):
    """The plan's exchanges go by the dealt key, not by token, key, bundle and installer title themselves."""
    labels = spark.createDataFrame([(f"app{i}", f"Name {i}", None) for i in range(9)], "name string, display_name string, package_id string")
    labels = labels.select("*", *(F.lit(None).cast("string").alias(c) for c in ("install_type", "download_url", "app_new_version", "expected_team_id")))
    casks = spark.createDataFrame([("app1", 1, "Name 1", "u", "1", "s")], "token string, ord int, name string, url string, version string, sha256 string").withColumn("artifacts", F.array(F.struct(F.array("name").alias("app"))))
    recipes = spark.createDataFrame([("r", "Name 2", "o/r", "p", "t")], "identifier string, name string, repo string, path string, inferred_type string")
    installers = spark.createDataFrame([(1, "Name 3", "Jamf", None, "1", "7", "u"), (2, "-", "Jamf", "", "1", "8", "u")], "ord int, title string, source string, bundle_id string, version string, jamf_id string, download_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        apps = stitch.label_apps(labels, casks, recipes, installers)
        plan = apps._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(__key") >= 4
        assert not any(f"SortMergeJoin [{c}#" in plan for c in ("token", "key", "bundle", "i_title"))
        assert {r.slug: r.sources for r in apps.collect() if len(r.sources) > 1} == {"app1": ["installomator", "homebrew_cask"], "app2": ["installomator", "autopkg"], "app3": ["installomator", "jamf_app_installer"]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_of_recipes_are_joined_last(spark):
    """Nothing shuffles or sorts rows that carry them already."""
    labels = spark.createDataFrame([("app1", "Name 1", None)], "name string, display_name string, package_id string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("install_type", "download_url", "app_new_version", "expected_team_id")))
    casks = spark.createDataFrame([("app1", 1, "Name 1", "u", "1", "s")], "token string, ord int, name string, url string, version string, sha256 string").withColumn("artifacts", F.array(F.struct(F.array("name").alias("app"))))
    recipes = spark.createDataFrame([("r2", "Name 1", "o/r", "p", "t"), ("r1", "name-1", "o/r", "p", "t")], "identifier string, name string, repo string, path string, inferred_type string")
    installers = spark.createDataFrame([(1, "Name 1", "Jamf", None, "1", "7", "u")], "ord int, title string, source string, bundle_id string, version string, jamf_id string, download_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        apps = stitch.label_apps(labels, casks, recipes, installers)
        formatted = apps._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        nodes = [x for x in formatted.split("\n\n") if x.startswith("(")]
        assert not [x for x in nodes if ("Exchange\n" in x.split("[codegen")[0] + "\n" or ") Exchange" in x) and "recipe_detail" in x.split("Arguments")[0]]
        row = apps.first()
        assert [r.identifier for r in row.recipe_detail] == ["r1", "r2"] and row.sources == list(stitch.SOURCE_ORDER)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_of_recipes_are_built_only_where_they_are_read(spark):
    """Coverage, sources and vendors ask whether an app has recipes; neither the lists nor the DISTINCT of recipes is computed for that."""
    labels = spark.createDataFrame([("app1", "Name 1", None), ("app2", "Name 2", None)], "name string, display_name string, package_id string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("install_type", "download_url", "app_new_version", "expected_team_id")))
    casks = spark.createDataFrame([("app1", 1, "Name 1", "u", "1", "s"), ("c3", 2, "Name 3", "u", "1", "s")], "token string, ord int, name string, url string, version string, sha256 string").withColumn("artifacts", F.array(F.struct(F.array("name").alias("app"))))
    rows = [("r2", "Name 1", "o/r", "p", "t"), ("r1", "name-1", "o/r", "p", "t"), ("r1", "name-1", "o/r", "p", "t"), ("r3", "Name 3", None, None, None), ("r4", "-", "o/r", "p", "t"), ("r5", None, "o/r", "p", "t")]
    recipes = spark.createDataFrame(rows, "identifier string, name string, repo string, path string, inferred_type string").distinct()
    installers = spark.createDataFrame([(1, "Name 1", "Jamf", None, "1", "7", "u")], "ord int, title string, source string, bundle_id string, version string, jamf_id string, download_url string")
    apps = stitch.stitch_catalog(labels, casks, recipes, installers)
    asked = {
        "j04": catalog.catalog_summary(apps), "i14": stitch.label_apps(labels, casks, recipes, installers).select("slug", "sources"),
        "f07": apps.select("slug", "sources"), "j07": apps.where("vendor is not null").select("vendor").distinct(), "counts": stitch.stitch_counts(apps),
    }
    for name, df in asked.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "identifier#" not in plan.replace("LogicalRDD [identifier#", ""), name
    assert asked["j04"].first().asDict() == {"total": 3, "installomator": 2, "homebrew_cask": 2, "autopkg": 2, "jamf_app_installer": 1}
    got = {r.slug: r for r in apps.collect()}
    assert {s: r.recipe_detail and [x.identifier for x in r.recipe_detail] for s, r in got.items()} == {"app1": ["r1", "r2"], "app2": None, "c3": ["r3"]}
    assert all((r.recipe_detail is not None) == ("autopkg" in r.sources) for r in got.values())
