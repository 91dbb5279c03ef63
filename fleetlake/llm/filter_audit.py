"""What each of several document filters removes, in every order, from sorted posting lists of failing ids.

Every row gets a place in the table. For each part (language) and range of places, each filter keeps
the sorted list of the places whose rows fail it; so do the rows labelled good and toxic. Unions of
filters' lists are merged from the union of all but one of them by galloping: the shorter list's
ids look their places up in the longer one, which is not walked through. Sizes of unions and of
their meets with the labelled lists add up over ranges, so a part of any size is spread over tasks,
and all orders of the filters follow from one small table of sums.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

#: Places of a range, as a power of two; a group of a task holds the lists of one range.
RANGE_BITS = 16
_SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a row's own text decides; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(place, part, good, toxic and a boolean for each filter) of every row of ``docs``.

    ``filters`` are conditions on the row (default: ``text_filters``); ``copies`` names a filter that a
    row fails if any row of the table with a smaller id has the same text (null is the empty text; a
    null id is neither smaller nor larger than any). A null part is ''. ``good`` and ``toxic`` tell
    whether any label of the id has quality 1 and toxic 1; null ids have no label. Texts are compared
    by SHA-256.
    """
    filters = filters if filters is not None else text_filters(F.col(text_col))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)) if copies else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), F.array(*(F.coalesce(c, F.lit(False)) for c in filters.values())).cast("array<boolean>").alias("fails"))
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "failures")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = rows.join(small(saved(marks, "marks")), "id", "left")
    fails = [F.col("fails")[i].alias(name) for i, name in enumerate(filters)]
    if copies:
        firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
        out = out.join(small(saved(firsts, "firsts")), "digest", "left")
        fails.append(F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias(copies))
    return out.select("place", "part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *fails)


def posting_lists(flags: DataFrame, names: list[str]) -> DataFrame:
    """(part, range, docs, a sorted list for each name): the places within the range whose row has the flag."""
    offset = F.col("place").bitwiseAND((1 << RANGE_BITS) - 1).cast("int")
    lists = (F.sort_array(F.collect_list(F.when(F.col(n), offset))).alias(n) for n in names)
    return flags.groupBy("part", F.shiftright("place", RANGE_BITS).alias("range")).agg(F.count("*").alias("docs"), *lists)


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of two sorted lists: those of the shorter one gallop to their places in the longer one."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    fresh = np.ones(len(b), bool)
    inner = at < len(a)
    fresh[inner] = a[at[inner]] != b[inner]
    return np.insert(a, at[fresh], b[fresh])


def meet_size(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids two sorted lists share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    inner = at < len(a)
    return int((a[at[inner]] == b[inner]).sum())


def _merged(k: int):
    """Sums (part, subset, docs, failed, good, toxic) of one range's postings; subset is a bit set of filters."""

    def run(postings: pa.Table) -> pa.Table:
        part, docs = postings.column(0)[0].as_py(), postings.column(2)[0].as_py()
        good, toxic, *fails = (c.combine_chunks().flatten().to_numpy() for c in postings.columns[3:])
        sums, unions = np.zeros((1 << k, 4), np.int64), [np.zeros(0, np.int32)]
        sums[0, 0] = docs
        for subset in range(1, 1 << k):
            high = subset.bit_length() - 1
            unions.append(union(unions[subset ^ 1 << high], fails[high]))
            sums[subset, 1:] = len(unions[-1]), meet_size(unions[-1], good), meet_size(unions[-1], toxic)
        return pa.table([pa.array([part] * (1 << k), pa.string()), pa.array(np.arange(1 << k, dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["part", "subset", "docs", "failed", "good", "toxic"])

    return run


def interaction_audit(flags: DataFrame, names: list[str]) -> DataFrame:
    """For each part, order of the filters ``names`` (at most six) and step: what the step's filter removes.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley),
    counts of rows of the part: left after the step, removed by it, failing its filter but removed
    before, failing its filter alone; removed here and labelled good, or toxic; ``shapley`` sums what
    the filter removes over all orders. ``flags`` is like that of ``failures``. Repeated rows count
    each; every part of the table has rows, also where nothing fails; an empty table gives no rows.
    """
    k = len(names)
    if not 0 < k <= 6:
        raise ValueError("one to six filters")
    postings = saved(posting_lists(flags, ["good", "toxic", *names]), "postings")
    sums = postings.groupBy("part", "range").applyInArrow(_merged(k), "part string, subset int, docs long, failed long, good long, toxic long")
    sums = sums.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("docs", "failed", "good", "toxic")))
    of = F.map_from_entries(F.collect_list(F.struct("subset", F.struct("failed", "good", "toxic"))))  # 2**k entries
    sums = sums.groupBy("part").agg(F.sum("docs").alias("docs"), of.alias("of"))
    orders = F.array(*(F.array(*map(F.lit, p)) for p in permutations(range(k))))
    steps = sums.select("part", "docs", "of", F.explode(orders).alias("order")).select("*", F.posexplode("order").alias("at", "filter"))
    bits = F.aggregate(F.slice("order", F.lit(1), F.col("at")), F.lit(0), lambda x, f: x + F.call_function("shiftleft", F.lit(1), f))
    steps = steps.withColumn("before", bits).withColumn("after", F.expr("before + shiftleft(1, filter)"))
    at = lambda subset, c: F.element_at("of", subset)[c]
    gone = lambda c: at(F.col("after"), c) - at(F.col("before"), c)
    own, every = F.expr("shiftleft(1, filter)"), F.lit((1 << k) - 1)
    out = steps.select(
        "part", F.array_join(F.transform("order", lambda f: F.element_at(F.array(*map(F.lit, names)), f + 1)), "").alias("filter_order"), (F.col("at") + 1).alias("step"), "filter",
        (F.col("docs") - at(F.col("after"), "failed")).alias("kept"), gone("failed").alias("removed"), (at(own, "failed") - gone("failed")).alias("redundant"),
        (at(every, "failed") - at(every - own, "failed")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
