"""Indexed search, keyset pages and nearest snapshots against scans and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import catalog, diff, search

SCHEMA = "slug string, name string, vendor string, bundle_id string, sources array<string>"


@pytest.fixture(scope="module")
def apps(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcAB-_%. éK", k=draw.randint(0, 7)))
    rows = [(f"app{i:03}", word() if i % 5 else None, draw.choice(["Acme", "Société", ""]), f"com.{word()}", draw.choice([["a"], ["b"], ["a", "b"], []])) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def test_indexed_search_gives_the_rows_of_the_scan(apps, tmp_path):
    path = str(tmp_path / "index")
    search.write_search_index(apps, path, 8)
    for query in ("app00", "APP", "abc", "ab", "a%c", "com.%ab", "b_a", "société", "ocié", "acme", "nothing like it", "", "100%", "Kab", "a.b", "com."):
        assert search.search_indexed(apps, path, query, 100).collect() == catalog.search_apps(apps, query, 100).collect(), query
    plan = search._wanted(apps.sparkSession, path, "postings", ["app"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "app" in plan.split("PushedFilters")[1]


def test_pages_join_up_and_late_ones_read_few_files(spark, apps, tmp_path):
    path = str(tmp_path / "catalog")
    search.write_catalog(apps, path, 10)
    for filters in ({}, {"vendor": "so%"}, {"source": "b"}):
        want = [r.slug for r in catalog.list_apps(apps, limit=1000, **filters).collect()]
        got, after = [], None
        while page := [r.slug for r in search.page_after(spark, path, after, 37, **filters).collect()]:
            got += page
            after = page[-1]
        assert got == want
    assert len(search.page_after(spark, path, "app250", 10).inputFiles()) <= 2
    assert search.page_after(spark, path, "zzz").collect() == []
    with pytest.raises(ValueError):
        search.page_after(spark, path, limit=1001)


def test_nearest_snapshots(spark):
    draw = random.Random(8)
    start = datetime(2019, 1, 1)
    times = sorted({start + timedelta(hours=draw.randint(0, 24 * 900)) for _ in range(40)})
    wanted = [start + timedelta(hours=draw.randint(-2000, 24 * 1000)) for _ in range(3000)] + times + [times[0] + (times[1] - times[0]) / 2, None]
    snaps = spark.createDataFrame([(t, i) for t in times for i in range(2)], "snapshot_ts timestamp, n int")
    frame = spark.createDataFrame(list(enumerate(wanted)), "id int, at timestamp")
    got = {r.id: r.snapshot_ts for r in diff.closest_snapshots(snaps, frame).collect()}
    assert got == {i: min(times, key=lambda t, w=w: (abs(t - w), t)) if w else None for i, w in enumerate(wanted)}
    assert {r.snapshot_ts for r in diff.closest_snapshots(snaps.limit(0), frame).collect()} == {None}
    assert diff.closest_snapshots(snaps, frame.where(F.lit(False))).collect() == []
