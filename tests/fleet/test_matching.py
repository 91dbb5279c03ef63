from pyspark.sql import functions as F

from fleetlake.operators import matching


def test_code_matches_are_not_shuffled(spark):
    """Titles times slugs of a code come from the last step, behind which there is no exchange."""
    titles = spark.range(40).select(F.col("id").cast("string").alias("title_id"), F.when(F.col("id") < 30, "A").otherwise("B").alias("name_id"))
    index = spark.createDataFrame([("A", ["s0", "s1", "s1", "s2"]), ("B", ["s3"]), ("C", [])], "code string, slugs array<string>")
    slugs = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "slug string")
    out = matching.match_by_code(titles, index, slugs)
    assert sorted(map(tuple, out.collect())) == sorted((str(i), pos, s) for i in range(30) for pos, s in ((1, "s1"), (2, "s1"), (3, "s2")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(found") < plan.index("Join")


def test_code_matches_come_in_short_runs_of_slugs(spark):
    """All titles of a code take a run of its slugs before the next run, so a written file repeats little."""
    titles = spark.range(30).select(F.col("id").cast("string").alias("title_id"), F.when(F.col("id") < 25, "A").alias("name_id"))
    index = spark.createDataFrame([("A", [f"s{i:04}" for i in range(600)])], "code string, slugs array<string>")
    rows = matching.match_by_code(titles, index, index.select(F.explode("slugs").alias("slug"))).collect()
    assert sorted(map(tuple, rows)) == sorted((str(i), pos, f"s{pos:04}") for i in range(25) for pos in range(600))
    runs = [r.pos // 256 for r in rows]
    assert sum(a != b for a, b in zip(runs, runs[1:], strict=False)) == 2
