import glob
import json

import pytest
from pyspark.sql import functions as F

from fleetlake.sources.titles import titles_envelope, write_titles_envelope


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay files of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_join_up_to_the_document(spark, tmp_path, uncoalesced):
    at = F.lit("2024-01-05 06:07:08").cast("timestamp")
    titles = spark.range(500).select((F.col("id") % 490).cast("string").alias("title_id"), F.concat(F.lit('say "x", ]} '), "id").alias("title"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n")).repartition(7)
    for i, df in enumerate((titles, titles.limit(1), titles.limit(0))):
        path = str(tmp_path / f"e{i}")
        assert write_titles_envelope(df, 'The "fleet"', at, path) == df.count()
        files = sorted(glob.glob(f"{path}/part-*"))
        got = json.loads("".join(open(f).read() for f in files))
        one = titles_envelope(df, 'The "fleet"', at).first()
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted(got.pop("titles"), key=key) == sorted(json.loads(one.titles), key=key)
        assert got == {"generated_at": got["generated_at"], "report_title": one.report_title, "title_count": one.title_count} and got["generated_at"].startswith("2024-01-05T06:07:08")
        assert i or len(files) > 1
