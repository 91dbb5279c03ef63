"""The flagship returns every drifting app, not a page of them."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from fleetlake.operators import catalog
from fleetlake.plans.queries import flagship
from fleetlake.plans.standins import Tables


def test_flagship_has_no_page(spark):
    apps = Tables(spark, "/root/testdata/sf0.001").apps.crossJoin(spark.range(110).withColumnRenamed("id", "copy"))
    apps = apps.withColumn("slug", F.concat_ws("-", "slug", "copy")).drop("copy").cache()
    want = catalog.detect_drift(apps).count()
    assert want > 1000 and flagship(SimpleNamespace(apps=apps)).count() == want
