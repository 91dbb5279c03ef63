"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often the mix takes each of its documents: a whole number of
copies, and one more with a fractional probability. The cube method settles these probabilities
without moving two totals of the source, that of documents and that of words: three unsettled
documents at a time move along the one direction that keeps both totals, up or down at random with
the odds that keep every probability, until one of them is settled at 0 or 1. Documents are dealt
into small buckets, whose flights leave at most two unsettled each; these meet in fewer and fewer
buckets. A few documents of every bucket, large and small, wait too; those that wait in a source's
last bucket are landed together with the two that its flight leaves: of all outcomes of that small
problem, one of those that come nearest to both totals is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: Documents of a bucket, about; and how many buckets' leavings meet in one of the next round.
BUCKET = 1024
FAN = 64
#: Documents of a bucket that are left for the next round or the landing, by their place, largest first; among so many of the best outcomes the landing draws.
RESERVE = (0, 1, 2, 3, 4, 5, 8, 16, 32, 64, 128, 256)
BEST = 16
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORDS)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: ranges are sorted, one count for each is gathered."""
    order = [F.col("source").isNull(), F.col("source")]
    line = saved(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    start, n = {}, 0
    for r in line.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row for each range
        start[r["p"]], n = n, n + r["n"]
    if not start:
        return line.withColumn("rank", F.col("at"))
    first = F.element_at(F.create_map(*(F.lit(x) for kv in start.items() for x in kv)), F.shiftright("at", 33))
    return line.withColumn("rank", first + F.col("at").bitwiseAND((1 << 33) - 1))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, docs, target) from (source, size) rows; a null source is one of its own.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size, and what is over goes to the others by
    weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = _ranked(sources)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = saved(sources.select("source", "rank", "source_size", "docs", weight.alias("weight"), (most * F.col("source_size")).alias("limit")), "sources")
    every = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, F.lit(False)  # words for each unit of weight of a source that its limit does not stop
    while True:
        r = sources.agg(F.coalesce(F.sum(F.when(stopped, F.col("limit"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        new = (every - r["held"]) / r["weight"] if r["weight"] else level
        if new <= level:
            break
        level, stopped = new, F.col("weight") * new >= F.col("limit")
    target = F.least(F.col("weight") * F.lit(level), F.col("limit").cast("double"))
    return sources.select("source", "rank", "source_size", "docs", target.alias("target"))


def _draw(rng: np.random.Generator, units: list[tuple[float, int, int]]) -> tuple[list[tuple[float, int, int]], list[tuple[float, int, int]]]:
    """(settled, unsettled) units (probability, size, row) after one move of up to three of them, which keeps the sums of probability and of probability times size."""
    sizes = [u[1] for u in units]
    if len(units) == 3:
        a, b, c = sizes
        move = [c - b, a - c, b - a]  # across (1, 1, 1) and the sizes
        if not any(move):
            move = [1, -1, 0]
    else:
        move = [1, -1] if sizes[0] == sizes[1] else [0, 0]
    if not any(move):
        return [], units
    up = min((1 - u[0]) / m if m > 0 else u[0] / -m for u, m in zip(units, move, strict=True) if m)
    down = min(u[0] / m if m > 0 else (1 - u[0]) / -m for u, m in zip(units, move, strict=True) if m)
    step = up if rng.random() * (up + down) < down else -down
    moved = [(u[0] + step * m, u[1], u[2]) for u, m in zip(units, move, strict=True)]
    settled = [(float(round(p)), s, r) for p, s, r in moved if min(p, 1 - p) < 1e-9]
    return settled, [u for u in moved if min(u[0], 1 - u[0]) >= 1e-9]


def _land(rng: np.random.Generator, units: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """All of some 14 units settled: by their own odds, one of the BEST outcomes in the sum of sizes, of those less than one unit off in number if there are any."""
    if not units:
        return []
    p, size = np.array([u[0] for u in units]), np.array([u[1] for u in units], float)
    outcomes = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off, units_off = np.abs((outcomes - p) @ size), np.abs((outcomes - p).sum(1))
    best = np.lexsort((off, units_off >= 1))[:BEST]
    best = best[(units_off[best] < 1) == (units_off[best[0]] < 1)]
    odds = np.where(outcomes[best] == 1, p, 1 - p).prod(1)
    chosen = outcomes[best[rng.choice(len(best), p=odds / odds.sum())]]
    return [(float(x), s, r) for x, (_, s, r) in zip(chosen, units, strict=True)]


def _flight(seed: int, land: bool):
    """Settles the probabilities of each (rank, bucket) of sorted rows; a task holds one batch and a few waiting rows. With ``land``, groups end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rng, units, reserve, first, place = None, None, [], [], 0, 0  # units go by the number of their row in the task
        waiting: dict[int, pa.RecordBatch] = {}
        for batch in batches:
            names = batch.schema.names
            rank, bucket, p, size = (batch.column(names.index(c)).to_pylist() for c in ("rank", "bucket", "p", "size"))
            rows, end, late = batch.drop_columns(["p"]), np.array(p, float), []

            def settle(done):
                for q, _, r in done:
                    if r < first:  # noqa: B023
                        late.append((waiting.pop(r), q))  # noqa: B023
                    else:
                        end[r - first] = q  # noqa: B023

            for i, key in enumerate(zip(rank, bucket, strict=True)):
                if key != group:
                    settle(_land(rng, units + reserve) if land else units + reserve)
                    group, rng, units, reserve, place = key, np.random.default_rng([seed, *key]), [], [], 0
                unit, place = (p[i], size[i], first + i), place + 1
                if place - 1 in RESERVE:
                    reserve.append(unit)
                    continue
                units.append(unit)
                if len(units) > 1:
                    done, units = _draw(rng, units)
                    settle(done)
            for r in (u[2] for u in units + reserve if u[2] >= first):
                waiting[r] = rows.slice(r - first, 1)
                end[r - first] = np.nan
            first += len(p)
            known = ~np.isnan(end)
            yield rows.filter(pa.array(known)).append_column("p", pa.array(end[known]))
            for row, q in late:
                yield row.append_column("p", pa.array([float(q)]))
        for q, _, r in _land(rng, units + reserve) if land else units + reserve:
            yield waiting[r].append_column("p", pa.array([float(q)]))

    return run


_ROWS = "id long, size long, tie long, rank long, bucket long, buckets long, p double"


def balanced_sample(rows: DataFrame, seed: int = 20) -> DataFrame:
    """``rows`` (id, size, tie, rank, p) with ``p`` settled at 0 or 1 for every row.

    Within each rank, in which ``p`` is to be the same for all rows, the number of rows at 1 and the
    sum of their sizes stay as expected but for the landing; each row is at 1 with its own
    probability (in the landing, nearly). The outcome depends on the rows alone, not on how they are dealt.
    """
    counts = rows.where("p > 0 and p < 1").groupBy("rank").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    counts = saved(counts, "buckets")
    todo = rows.where("p > 0 and p < 1").join(small(counts), "rank")
    todo = todo.withColumn("bucket", F.pmod(F.xxhash64("id", "tie"), "buckets")).select("id", "size", "tie", "rank", "bucket", "buckets", "p")
    most = counts.agg(F.max("buckets")).first()[0] or 0
    done = rows.where("p <= 0 or p >= 1").select("id", "size", "rank", "p")
    while most:
        order = ["rank", "bucket", F.desc("size"), F.xxhash64("id", "tie"), "id", "tie"]
        dealt = todo.repartition("rank", "bucket").sortWithinPartitions(*order)
        # a rank that needs no further round is landed now, others when theirs is the last
        flown = saved(dealt.mapInArrow(_flight(seed + most, most == 1), _ROWS), "flown")
        done = done.union(flown.where("p = 0 or p = 1").select("id", "size", "rank", "p"))
        if most == 1:
            break
        todo = flown.where("p > 0 and p < 1").withColumns({"bucket": F.floor(F.col("bucket") / FAN), "buckets": F.ceil(F.col("buckets") / FAN)})
        most = -(-most // FAN)
    return done


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row: how often a mix to ``weights`` takes it.

    ``size`` counts the words of the whole text (null: 0), ``copies`` is a whole number from 0 to
    ``most``, ``taken`` their product. Targets are those of ``source_targets``; a source's taken words
    differ from its target as little as its landing's documents allow. Null sources are one
    source, null ids, empty texts and repeated rows are rows of their own (fully equal ones are
    settled in one task, in bounded memory); a source without words has target 0 and is not taken; an
    empty table gives no rows. The same rows give the same mix in every run.
    """
    text = F.col(text_col)
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    sizes = saved(sizes, "sizes")
    targets = saved(source_targets(sizes, weights, most), "targets")
    named = targets.withColumnRenamed("source", "of")
    times = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rate = F.when(F.abs(times - F.round(times)) < 1e-9, F.round(times)).otherwise(times)
    rows = sizes.join(small(named), F.col("source").eqNullSafe(F.col("of"))).withColumn("times", rate)
    rows = rows.select("id", "size", "tie", "rank", (F.col("times") - F.floor("times")).alias("p"))
    taken = balanced_sample(rows, seed)
    out = taken.join(small(targets.withColumn("times", rate)), "rank")
    out = out.withColumn("copies", (F.floor("times") + F.col("p")).cast("int"))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
