"""XML that does not parse gives no rows and does not stop the job."""

from fleetlake.operators.lines import xpath_values
from fleetlake.plans.queries import QUERIES
from fleetlake.plans.standins import Tables


def test_bad_xml_gives_no_rows(spark):
    rows = [(1, "<a><i>x</i></a>"), (2, "<a><i>x</i>"), (3, "<a><b></a>"), (4, "text"), (5, None), (6, ""), (7, "<?xml version='1.0' encoding='latin-1'?><a><i>é</i></a>"), (8, "<a>&none;</a>")]
    out = xpath_values(spark.createDataFrame(rows, "id int, xml string"), "/a/i")
    assert out.columns == ["id", "xml", "value"]
    assert sorted((r.id, r.value) for r in out.collect()) == [(1, "x"), (7, "é")]


def test_query_reads_the_whole_of_part(spark):
    plan = QUERIES["t10_xpath_values"][0](Tables(spark, "/root/testdata/sf0.001"))
    assert "Filter" not in plan._jdf.queryExecution().analyzed().toString()
    assert plan.where("p_partkey % 5 = 0").count() == 0 and plan.count() > 0
