"""grep and cut on small inputs, by hand."""

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import lines


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, 1, "a:b:c"), (1, 2, "plain"), (1, 3, ""), (2, 1, "x1 y22 z"), (2, 2, None)], "doc_id int, line_no int, line string")


def values(df):
    return [r.line for r in df.orderBy("doc_id", "line_no").collect()]


@pytest.mark.parametrize(
    "fields, want",
    [("2", ["b", "", "", "", None]), ("3,1", ["c:a", "plain", "", "x1 y22 z", None]), ("1,1-2", ["a:a:b", "plain:plain", ":", "x1 y22 z:x1 y22 z", None]), ("2-", ["b:c", "", "", "", None]), ("0", ["", "", "", "", None]), ("3-2", ["", "", "", "", None])],
)
def test_cut_in_the_order_asked_for(table, fields, want):
    assert values(lines.cut(table, ":", fields)) == want


def test_cut_posix(table):
    assert values(lines.cut(table, ":", "3,1", posix=True)) == ["a:c", "plain", "", "x1 y22 z", None]


def test_grep_only_takes_the_first_match_of_a_line(table):
    assert values(lines.grep(table, "[0-9]+", only=True)) == ["1"]
    assert values(lines.grep(table, "[0-9]*", only=True)) == ["", "", "", ""]
    assert values(lines.grep(table, "[0-9]+", only=True, every=True)) == ["1", "22"]


def test_ranges_give_the_same_rows_and_spread_a_long_document(spark):
    """One document of 60,000 lines among small ones, null ids and null lines."""
    long = spark.range(60_000).select(F.lit(7).alias("doc_id"), (F.col("id") + 1).cast("int").alias("line_no"), F.concat(F.lit("line "), F.pmod(F.xxhash64("id"), F.lit(900))).alias("line"))
    df = long.union(spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (2, 1, None), (2, 2, "10"), (2, 3, "9"), (None, 1, "x"), (None, 2, "x")], "doc_id int, line_no int, line string"))
    rows = lambda out: sorted(map(str, (tuple(r) for r in out.select("doc_id", "line_no", "line").collect())))
    for options in ({}, {"reverse": True}, {"numeric": True}):
        assert rows(lines.sort_lines(df, ranged=True, **options)) == rows(lines.sort_lines(df, **options))
    assert rows(lines.uniq(lines.sort_lines(df), ranged=True)) == rows(lines.uniq(lines.sort_lines(df)))
    placed = df.repartitionByRange(8, "doc_id", "line", "line_no").where("doc_id = 7")
    assert placed.select(F.spark_partition_id()).distinct().count() >= 7
