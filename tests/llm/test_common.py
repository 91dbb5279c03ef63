"""Helpers: keys without clashes, bounded broadcasts, deleted tables."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetlake.llm.common import discard, row_bytes, saved, small, text_key
from fleetlake.llm.graph import components


def test_keys_of_different_rows_differ_even_if_hashes_clash(spark, odd):
    weak = lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))
    for first in (F.xxhash64, weak):
        keyed = odd.select("doc_id", "text", text_key(odd, "doc_id", "text", first=first).alias("key"))
        assert keyed.select("key").distinct().count() == odd.select("doc_id", "text").distinct().count() == keyed.distinct().count()


def test_broadcasts_are_bounded_by_bytes(spark):
    df = saved(spark.createDataFrame([(1, "abc", [1, 2, 3], ["x", "y"]), (None, None, None, None)], "a long, b string, c array<long>, d array<string>"), "t")
    sizes = [r[0] for r in df.select(row_bytes(df.schema)).collect()]
    assert sorted(sizes) == [48 + 32, 48 + 3 + 32 + 24 + 64]
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(df)).lower() and "broadcast" not in plan(small(df, limit=100)).lower()
    discard(df)
    with pytest.raises(AnalysisException):
        spark.read.parquet(df.saved_at)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (260, 261), (261, 260), (261, 260)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {i: 7 for i in (7, *range(200, 260))} | {260: 260, 261: 260}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
