"""Contiguous shards of near-equal bytes, cut from global prefix sums of per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch

SHARDS = 8
#: A cut moves to the edge of a group of equal texts if that is nearer than this share of a shard.
SNAP = 0.005


def _placed(totals: dict[int, tuple[int, int]], cuts: list[int]):
    """Row numbers and shards; a row belongs to the shard in which its middle byte falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, row = totals.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            size = batch.column(1).to_numpy()
            end = at + np.cumsum(size)
            shard = np.searchsorted(cuts, end - (size + 1) // 2, "right").astype(np.int32)
            number = row + np.arange(len(size))
            yield pa.record_batch([*batch.columns, pa.array(end), pa.array(number), pa.array(shard)], names=["doc_id", "size", "text_crc32", "digest", "end", "row", "shard"])
            at, row = (int(end[-1]) if len(end) else at), row + len(size)

    return run


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, in ``shards`` contiguous runs of near-equal total size.

    A row's size is its text's UTF-8 bytes plus 1 (null: 1). Rows stand in order of a digest of the
    text, then id, so equal texts are neighbours; a cut that falls into a group of them moves to the
    group's edge if that is near, else the group is split, as balance is the law. Shards differ from
    the target by at most one row or that move. Slots count from 0 within a shard. Null ids sort
    first; repeated rows keep separate slots; with fewer rows than shards, some shards stay empty.
    Only ids, sizes and digests are sorted and moved, never texts.
    """
    scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    line = saved(rows, "sizes").repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id").checkpoint()
    totals, at, count = {}, 0, 0
    for r in line.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("p").collect():
        totals[r["p"]] = (at, count)
        at, count = at + r["s"], count + r["n"]
    cuts = [at * k // shards for k in range(1, shards)]
    kind = "doc_id long, size long, text_crc32 long, digest long, end long, row long, shard int"
    placed = line.mapInArrow(_placed(totals, cuts), kind)
    # the groups that the cuts fall into: a handful of digests
    hit = placed.where(F.exists(F.array(*(F.lit(c) for c in cuts)).cast("array<long>"), lambda c: (c <= F.col("end")) & (c > F.col("end") - F.col("size")))).select("digest").distinct()
    groups = placed.join(F.broadcast(hit), "digest").groupBy("digest").agg(F.min(F.col("end") - F.col("size")).alias("a"), F.max("end").alias("b")).collect()
    for i, c in enumerate(cuts):
        edges = [e for g in groups if g["a"] < c <= g["b"] for e in (g["a"], g["b"])]
        near = min(edges, key=lambda e: abs(e - c), default=c)
        if abs(near - c) <= SNAP * at / shards:
            cuts[i] = near
    placed = line.mapInArrow(_placed(totals, cuts), kind)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
