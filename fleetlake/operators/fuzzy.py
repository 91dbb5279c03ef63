"""The best catalog slug of each name by indel ratio, through exact indexes: no pair that reaches the threshold is missed.

Strings that differ from many others in their digits alone go by kinds. A kind is what is left of a string
without its digits; the indel distance is at least that of the kinds plus that of the digits, and just
that where the digits stand last. The commonest kinds of both sides are compared with each other; what a pair
of kinds leaves of the distance decides how many digits are taken out on each side before strings meet. This
goes on distance by distance, with names for which a better slug may still exist.

The other strings meet by all of their characters. Two strings at indel distance d have a common subsequence that is left if x characters are taken out
of one and y out of the other, x + y = d. Distances up to two, where nearly all best matches lie, are
found by joining on the strings that are left; this gives the true pairs and no others. Names for
which no better slug can exist are done then. The rest are joined with up to two characters left out
on both sides. Pairs of lengths for which the threshold allows more meet through segments: of d + 1
disjoint segments of a slug one at least stands whole in the name, shifted no more than the edits
before and after it allow; a slug is cut into a few segments more and its hottest ones are left out.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio, lcs_length, without
from ..sources.storage import saved

#: Names and slugs of up to so many characters are indexed with one or two characters left out.
SHORT = 40
#: Segments of a slug beyond the d + 1 that are needed, if they keep two characters each.
SPARE = 2
#: Commonest kinds of a side that are compared kind by kind; results do not depend on it.
KINDS = 1024
#: Strings that a kind has at least for that, if there are more kinds.
CROWD = 8
#: Digits of a string up to which it goes by its kind.
DIGITS = 12


def distance(n: int, m: int, threshold: float) -> int:
    """The largest indel distance with which strings of n and m characters reach the threshold; below 0 if none does."""
    d = math.floor((1 - threshold / 100) * (n + m) + 1e-9)
    d -= (d - n - m) % 2
    return d if d >= abs(n - m) else -1


def segment_plan(n: int, m: int, d: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(n, m, d, segment, start, first, last) of each segment of a slug of m characters, and where it may start in a name of n.

    d + 1 segments are kept of each slug; the j-th of these stands whole with at most j edits before it
    and d - j behind it for some j. ``start`` is followed by the next segment's start or the end.
    """
    pieces = d + 1 + max(0, min(SPARE, m // 2 - d - 1))
    if m < pieces:
        return []
    cuts = [m * i // pieces for i in range(pieces + 1)]
    inserted, removed = (d + n - m) // 2, (d - n + m) // 2
    out = []
    for q, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        before, behind = min(q, d), d - max(0, q - (pieces - d - 1))
        first = start + max(-removed, -before, n - m - behind)
        last = start + min(inserted, before, n - m + behind)
        first, last = max(first, 0), min(last, n - (end - start))
        if first <= last:
            out.append((n, m, d, q, start, end - start, first, last))
    return out


#: Characters taken out of a name and of a slug: first those that make distances up to two, then the rest of up to two each.
FIRST, SECOND = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2)), ((2, 1), (1, 2), (2, 2))


def close_pairs(names: DataFrame, slugs: DataFrame, threshold: float, taken_out: tuple[tuple[int, int], ...] = FIRST) -> DataFrame:
    """(name, slug, ratio) of pairs that reach the threshold: equal ones of any length, and those of up to SHORT characters that are alike once so many are taken out of each.

    What is taken out of both sides gives the distance, so no ratio is worked out. A pair can come more than once, also with a lower ratio than its own.
    The joins are merges: what is left of the strings takes hundreds of times their tables' size, by which Spark would choose a broadcast.
    """
    names, slugs = names.select("name", F.length("name").alias("n")), slugs.select("slug", F.length("slug").alias("m"))
    taken = lambda df, c, size, k: df.where(F.col(size) <= SHORT).select(c, size, F.explode(without(c, k, distinct=False)).alias("left"))
    pairs = [names.join(slugs.hint("merge"), names["name"] == slugs["slug"]).select("name", "slug", F.lit(100.0).alias("ratio"))]
    both = F.col("n") + F.col("m")
    for x, y in taken_out:
        ratio = 200.0 * (F.col("n") - x) / both
        pairs.append(taken(names, "name", "n", x).join(taken(slugs, "slug", "m", y).hint("merge"), "left").select("name", "slug", ratio.alias("ratio")).where(F.col("ratio") >= threshold))
    return reduce(DataFrame.union, pairs)


def left_out_suffices(n: int, m: int, d: int) -> bool:
    """Whether ``close_pairs`` finds all pairs of these lengths up to distance d."""
    return max(n, m) <= SHORT and (d + n - m) // 2 <= 2 and (d - n + m) // 2 <= 2


def segment_pairs(names: DataFrame, slugs: DataFrame, threshold: float) -> DataFrame | None:
    """(name, slug) pairs that share a segment where the threshold allows it: all that reach the threshold, and others.

    Lengths for which ``left_out_suffices`` are left out.
    None if no lengths allow any. Only lengths come to the driver; the plan of segments has a row for each pair of lengths and segment.
    """
    spark = names.sparkSession
    lengths = lambda df, c: [r[0] for r in df.select(F.length(c)).distinct().collect()]
    plan = [row for n in lengths(names, "name") for m in lengths(slugs, "slug") if (d := distance(n, m, threshold)) >= 0 and not left_out_suffices(n, m, d) for row in segment_plan(n, m, d)]
    if not plan:
        return None
    plan = F.broadcast(spark.createDataFrame(plan, "n int, m int, d int, q int, start int, size int, first int, last int"))
    cut = slugs.withColumn("m", F.length("slug")).join(plan, "m").select("slug", "n", "m", "d", "q", F.substring("slug", F.col("start") + 1, F.col("size")).alias("segment"))
    cut = saved(cut, "segments")
    key = ["n", "m", "q", "segment"]
    rare = cut.join(cut.groupBy(key).agg(F.count("*").alias("count")).hint("merge"), key)
    rank = F.row_number().over(Window.partitionBy("slug", "n").orderBy("count", "q"))
    index = rare.withColumn("rank", rank).where("rank <= d + 1").select("slug", *key)
    probes = names.withColumn("n", F.length("name")).join(plan, "n").select("name", "n", "m", "q", "size", F.explode(F.sequence("first", "last")).alias("at"))
    probes = probes.select("name", "n", "m", "q", F.substring("name", F.col("at") + 1, F.col("size")).alias("segment")).distinct()
    return probes.join(index.hint("merge"), key).select("name", "slug").distinct()


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with their ratio, if it reaches the threshold; the edit distance, which never exceeds the indel distance, goes first."""
    both = F.length("name") + F.length("slug")
    near = F.levenshtein("name", "slug") <= (1 - threshold / 100) * both + 1e-9
    # a table between the two keeps the ratio from being worked out beside the filter
    return saved(pairs.where(near), "near").select("name", "slug", indel_ratio("name", "slug").alias("ratio")).where(F.col("ratio") >= threshold)


def _best(pairs: DataFrame) -> DataFrame:
    """(name, b): the greatest ratio, negated, and its first slug."""
    return pairs.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "slug")).alias("b"))


def _reached(name: str, d: int) -> Column:
    """A ratio that no slug at indel distance ``d`` or more exceeds."""
    return F.lit(100.0) * (1 - F.lit(float(d)) / (2 * F.length(name) + d)) + 1e-9


def split_kinds(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the commonest kinds: c, kind, its number ``of``, digits, their number ``size``, whether they stand last; the other rows' c)."""
    rows = df.select(c, F.translate(c, "0123456789", "").alias("kind"), F.regexp_replace(c, "[^0-9]", "").alias("digits"))
    rows = rows.withColumns({"size": F.length("digits"), "last": F.concat("kind", "digits") == F.col(c)})
    counts = saved(rows.where(F.col("size") <= DIGITS).groupBy("kind").agg(F.count("*").alias("count")), "kinds")
    least = 1 if counts.count() <= KINDS else CROWD
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "kind").limit(KINDS)
    top = saved(top.select("kind", (F.row_number().over(Window.orderBy("kind")) - 1).alias("of")), "kinds")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = saved(rows.join(F.broadcast(top), "kind", "left").repartition(parts, c), "split")
    fits = F.col("of").isNotNull() & (F.col("size") <= DIGITS)
    return met.where(fits), met.where(~fits).select(c)


def kind_plan(names: DataFrame, slugs: DataFrame, threshold: float) -> DataFrame:
    """(a, n_size, b, m_size, x, y, e, exact): kinds and numbers of digits of names and slugs, and how many digits are taken out of each for pairs at distance e.

    Rows are bounded by KINDS and DIGITS. If not ``exact``, some digits stand before other characters and e is the least distance.
    """
    one = names.select(F.col("of").alias("a"), F.col("kind").alias("n_kind"), F.col("size").alias("n_size"), F.col("last").alias("n_last")).distinct()
    two = slugs.select(F.col("of").alias("b"), F.col("kind").alias("m_kind"), F.col("size").alias("m_size"), F.col("last").alias("m_last")).distinct()
    one, two = saved(one, "shapes"), saved(two, "shapes")
    room = lambda n, m: (1 - threshold / 100) * (F.length("n_kind") + F.col(n) + F.length("m_kind") + F.col(m)) + 1e-9
    kinds = one.groupBy("a", "n_kind").agg(F.max("n_size").alias("n")).crossJoin(F.broadcast(two.groupBy("b", "m_kind").agg(F.max("m_size").alias("m"))))
    near = saved(kinds.where((F.abs(F.length("n_kind") - F.length("m_kind")) <= room("n", "m")) & (F.levenshtein("n_kind", "m_kind") <= room("n", "m"))), "near")
    apart = F.length("n_kind") + F.length("m_kind") - 2 * lcs_length("n_kind", "m_kind")
    near = saved(near.select("a", "b", "n", "m", "n_kind", "m_kind", apart.cast("int").alias("apart")), "near").where(F.col("apart") <= room("n", "m"))
    plan = near.join(F.broadcast(one.drop("n_kind")), "a").join(F.broadcast(two.drop("m_kind")), "b")
    more = F.col("n_size") - F.col("m_size")
    plan = plan.where(F.col("apart") + F.abs(more) <= room("n_size", "m_size")).withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), -more), F.col("m_size"))))
    plan = plan.withColumn("x", F.col("y") + more).withColumn("e", F.col("apart") + F.col("x") + F.col("y")).where(F.col("e") <= room("n_size", "m_size"))
    return saved(plan.select("a", "n_size", "b", "m_size", "x", "y", "e", (F.col("n_last") & F.col("m_last")).alias("exact"), "n_last", "m_last"), "plan")


def _taken_out(rows: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (digits, size, out, more), a row for each way to take ``out`` digits out, with the rest as a whole number ``left``; ``sizes`` has all (size, out).

    As in ``without``, the first ones of a run of equal digits go.
    """
    most = max(out for _, out in sizes)
    at = [f"at{i}" for i in range(most)]
    ways = [(size, out, *places, *[size + 1] * (most - out)) for size, out in sizes for places in combinations(range(1, size + 1), out)]
    ways = pa.table({c: pa.array(v, pa.int32()) for c, v in zip(("size", "out", *at), zip(*ways, strict=True), strict=True)})
    ways = rows.sparkSession.createDataFrame(ways)
    rows = rows.join(F.broadcast(ways), ["size", "out"])
    digit = lambda i: F.substr("digits", i, F.lit(1))
    for i, c in enumerate(at):
        before = F.col(at[i - 1]) == F.col(c) - 1 if i else F.lit(False)
        rows = rows.where((F.col(c) == 1) | (F.col(c) > F.col("size")) | before | (digit(F.col(c)) != digit(F.col(c) - 1)))
    ends = [F.lit(0), *(F.col(c) for c in at), F.col("size") + 1]
    pieces = [F.substr("digits", a + 1, F.greatest(b - a - 1, F.lit(0))) for a, b in zip(ends, ends[1:], strict=False)]
    return rows.withColumn("left", F.concat(F.lit("1"), *pieces).cast("long")).drop(*at)


def kind_pairs(names: DataFrame, slugs: DataFrame, plan: DataFrame) -> DataFrame:
    """(name, slug, e) of all pairs of rows of ``split_kinds`` that the rows of ``plan`` allow; a pair can come more than once, also with a greater e than its own."""
    sizes = lambda size, out: [tuple(r) for r in plan.select(size, out).distinct().collect()]
    # one number for a slug's kind, what is taken out of it and what is left of it
    key = ((F.col("b").cast("long") * (DIGITS + 1) + F.col("y")) * (2 * 10**DIGITS) + F.col("left")).alias("key")
    one = plan.select(F.col("a").alias("of"), F.col("n_size").alias("size"), F.col("n_last").alias("last"), "b", F.col("x").alias("out"), "y", "e").distinct()
    one = _taken_out(names.join(F.broadcast(one), ["of", "size", "last"]), sizes("n_size", "x"))
    two = plan.select(F.col("b").alias("of"), F.col("m_size").alias("size"), F.col("m_last").alias("last"), "b", F.col("y").alias("out"), "y").distinct()
    two = _taken_out(slugs.join(F.broadcast(two), ["of", "size", "last"]), sizes("m_size", "y"))
    return one.select(key, "name", "e").join(two.select(key, "slug").hint("merge"), "key").select("name", "slug", "e")


def _by_kind(names: DataFrame, slugs: DataFrame, threshold: float) -> list[DataFrame]:
    """Tables of (name, b) among rows of ``split_kinds``; the best b of a name is in one of them."""
    plan = kind_plan(names, slugs, threshold)
    steps = sorted(r[0] for r in plan.select(F.greatest("e", F.lit(2)).alias("e")).distinct().collect())  # no more than a distance can be
    found: list[DataFrame] = []
    for step in steps:
        if found:
            done = reduce(DataFrame.union, found).where(-F.col("b.r") > _reached("name", step)).select("name").distinct()
            names = saved(names.join(done.hint("merge"), "name", "left_anti"), "rest")
        now = plan.where(F.greatest("e", F.lit(2)) == step)
        both = F.length("name") + F.length("slug")
        ratio = F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.floor((both - F.col("e")) / 2) / both)
        for exact in [r[0] for r in now.select("exact").distinct().collect()]:
            pairs = kind_pairs(names, slugs, now.where(F.col("exact") == exact))
            pairs = pairs.select("name", "slug", ratio.alias("ratio")).where(F.col("ratio") >= threshold) if exact else _scored(pairs.select("name", "slug").distinct(), threshold)
            found.append(saved(_best(pairs), "close"))
    return found


def _by_characters(names: DataFrame, slugs: DataFrame, threshold: float) -> list[DataFrame]:
    """Tables of (name, b); the best b of a name is in one of them."""
    close = saved(_best(close_pairs(names, slugs, threshold)), "close")
    done = close.where((F.col("b.r") == -100) | ((F.length("name") <= SHORT - 2) & (-F.col("b.r") > _reached("name", 3))))
    rest = saved(names.join(done.hint("merge"), "name", "left_anti"), "rest")
    found = [close, _best(close_pairs(rest, slugs, threshold, SECOND))]
    far = segment_pairs(rest, slugs, threshold)
    if far is not None:
        found.append(_best(_scored(far, threshold)))
    return found


def similar_names(names: DataFrame, slugs: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(name, slug, ratio): the best slug of each distinct name by indel ratio, if it reaches the threshold; ties by slug.

    Thresholds up to 66.7 raise, as segments of one character join nearly all pairs there. Null names and
    slugs match nothing; an empty name matches only an empty slug.
    """
    if threshold <= 200 / 3:
        raise ValueError("threshold must be over 66.7")
    names, slugs = names.select("name").where("name is not null").distinct(), slugs.select("slug").where("slug is not null").distinct()
    (of_kinds, others), (slugs_of_kinds, other_slugs) = split_kinds(names, "name"), split_kinds(slugs, "slug")
    found = _by_kind(of_kinds, slugs_of_kinds, threshold)
    if not others.isEmpty():
        found += _by_characters(others, slugs_of_kinds.select("slug").union(other_slugs), threshold)
    if not other_slugs.isEmpty():
        found += _by_characters(of_kinds.select("name"), other_slugs, threshold)
    if not found:
        return names.select("name", F.lit("").alias("slug"), F.lit(0.0).alias("ratio")).limit(0)
    out = reduce(DataFrame.union, found).groupBy("name").agg(F.min("b").alias("b"))
    return out.select("name", F.col("b.slug").alias("slug"), (-F.col("b.r")).alias("ratio"))
