"""Incremental trends, bucketed upserts and file intake against what one full run gives."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import incremental as inc
from fleetlake.operators import trends
from fleetlake.plans.standins import Tables
from fleetlake.sources import snapshots, storage
from fleetlake.streaming.files import take_in


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


def agree(spark, snaps, state):
    releases, latest = inc.read_state(spark, state)
    pairs = [
        (trends.patch_adoption(snaps), inc.patch_adoption(releases)), (trends.release_frequency(snaps), inc.release_frequency(releases)), (trends.completion_trends(snaps), inc.completion_trends(releases)),
        (trends.time_to_patch(snaps), inc.time_to_patch(releases)), (trends.time_to_patch(snaps, 80.0, True), inc.time_to_patch(releases, 80.0, True)),
        (trends.excluded_titles(snaps), inc.excluded_titles(releases)), (trends.stale_apps(snaps), trends.stale_apps(latest)),
    ]
    for want, got in pairs:
        assert rows(got) == rows(want)


def test_state_equals_the_full_run_after_each_date(spark, tmp_path):
    path, state = str(tmp_path / "snaps"), str(tmp_path / "state")
    every = Tables(spark, "/root/testdata/sf0.001").snapshots
    odd = spark.createDataFrame([("odd", "x1", "no date", 1, 1, "1", 33.335), (" ", "x2", "Jan 02 1992", 1, 1, None, 90.0), (None, "x3", "Jan 02 1992", 1, 1, "1", 90.0), ("odd", "x4", None, 1, 1, "2", None)], "title string, title_id string, released string, hosts_patched long, missing_patch long, latest_version string, completion_percent double")
    with pytest.raises(ValueError):
        inc.read_state(spark, state)
    dates = sorted(r[0] for r in every.select("snapshot_ts").distinct().collect())
    for d in dates[:4]:
        part = every.where(F.col("snapshot_ts") == F.lit(d)).select(odd.columns).union(odd)
        snapshots.write_snapshot(part, path, d)
        table = snapshots.read_snapshots(spark, path)
        assert inc.update_trends(table, state) is not None and inc.update_trends(table, state) is None
        agree(spark, table, state)


def test_an_update_reads_the_new_partition_alone(spark, tmp_path):
    path, state = str(tmp_path / "snaps"), str(tmp_path / "state")
    every = Tables(spark, "/root/testdata/sf0.001").snapshots
    dates = sorted(r[0] for r in every.select("snapshot_ts").distinct().collect())[:3]
    for d in dates:
        snapshots.write_snapshot(every.where(F.col("snapshot_ts") == F.lit(d)).drop("snapshot_ts"), path, d)
    table = snapshots.read_snapshots(spark, path)
    inc.update_trends(table.where(F.col("snapshot_date") < F.lit(dates[2].date())), state)
    for old in glob.glob(f"{path}/snapshot_date=*"):
        if not old.endswith(str(dates[2].date())) and not old.endswith(str(dates[1].date())):
            os.rename(old, f"{tmp_path}/gone")  # a run that read it would fail
    assert inc.update_trends(table, state) is not None
    assert sum(r.n for r in inc.read_state(spark, state)[0].select("n").collect()) == every.where(F.col("snapshot_ts").isin(dates)).count()


def files(path):
    return {os.path.relpath(f, path): os.path.getmtime(f) for f in glob.glob(f"{path}/rows/bucket=*/*.parquet")}


def test_bucketed_upsert_touches_what_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(0).alias("ord")).union(spark.createDataFrame([(None, "none", 0)], "k long, v string, ord int"))
    storage.write_bucketed(base, path, ["k"], 16)
    before = files(path)
    updates = spark.createDataFrame([(3, "new", 2), (3, "older", 1), (500, "added", 1), (7, "v7", 0), (None, "none2", 1)], "k long, v string, ord int")
    want = rows(storage.upsert(base.where("k is not null"), updates.where("k is not null"), ["k"]).union(updates.where("k is null")))
    n = storage.upsert_bucketed(updates, path)
    assert 1 <= n <= 3 and rows(storage.read_bucketed(spark, path)) == want
    after = files(path)
    assert len({os.path.dirname(f) for f in set(before) ^ set(after)}) == n and all(before[f] == after[f] for f in set(before) & set(after))
    assert storage.upsert_bucketed(updates, path) == 0 and files(path) == after
    bad = updates.withColumn("v", F.when(F.col("k") == 500, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        storage.upsert_bucketed(bad, path)
    assert files(path) == after and rows(storage.read_bucketed(spark, path)) == want


def test_landed_files_are_taken_in_once(spark, tmp_path):
    folder, table, done = (str(tmp_path / x) for x in ("in", "table", "done"))
    os.makedirs(folder)
    schema = "k long, v string, ord long"
    storage.write_bucketed(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema), table, ["k"], 4)
    with open(f"{folder}/1.json", "w") as f:
        f.write('{"k": 1, "v": "c", "ord": 1}\nnot json\n{"k": 3, "v": "d", "ord": 1}\n')
    assert take_in(spark, folder, schema, table, done, ord="ord") == 2
    held = files(table)
    assert take_in(spark, folder, schema, table, done, ord="ord") == 0 and files(table) == held
    with open(f"{folder}/2.json", "w") as f:
        f.write('{"k": 3, "v": "e", "ord": 2}\n{"k": 3, "v": "f", "ord": 5}\n')
    assert take_in(spark, folder, schema, table, done, ord="ord") == 2
    assert sorted(map(tuple, storage.read_bucketed(spark, table).collect())) == [(1, "c", 1), (2, "b", 0), (3, "f", 5)]
