"""String similarity as built-in expressions: the longest common subsequence by rows of bits, and strings with characters left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Characters whose bits one long holds, with one bit left for the carry.
BLOCK = 62


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often a lambda in it reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(c: Column | str) -> Column:
    """The code points of a string, one string each."""
    c = col(c)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _masks(own: Column) -> Column:
    """A map from each of up to BLOCK characters to the bits of its places."""
    bits = lambda c: F.aggregate(F.transform(own, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    return F.map_from_entries(F.transform(F.array_distinct(own), lambda c: F.struct(c.alias("c"), bits(c).alias("bits"))))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two strings, in code points; null if either is null.

    A row of bits, one for each character of ``a``, is folded over the characters of ``b``; each step is
    a sum whose carries do the work of a row of the usual table. Strings of over BLOCK characters keep
    one long for each BLOCK of them and hand the carry on.
    """
    a, b = col(a), col(b)
    chars, full = characters(a), F.lit((1 << BLOCK) - 1)
    of = lambda masks, c: F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long"))
    step = lambda row, m: ((row + row.bitwiseAND(m)).bitwiseOR(row.bitwiseAND(F.bitwise_not(m)))).bitwiseAND(full)
    ones = F.expr(f"shiftleft(1L, {BLOCK}) - 1")
    hits = bound(chars, lambda own: bound(_masks(own), lambda masks: F.transform(characters(b), lambda c: of(masks, c))))
    short = F.aggregate(hits, ones, step)
    # bits beyond the string never change, so the zeros are the common characters
    short_length = F.lit(BLOCK) - F.bit_count(short)
    # longer strings: (carry, rows so far) over the blocks' masks of each character
    starts = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / BLOCK).cast("int"))
    blocks = bound(chars, lambda own: F.transform(starts, lambda i: bound(F.slice(own, i * BLOCK + 1, F.lit(BLOCK)), _masks)))
    zero = F.lit(0).cast("long")

    def long_step(rows: Column, hits: Column) -> Column:
        pairs = F.zip_with(rows, hits, lambda row, hit: F.struct(row.alias("row"), hit.alias("hit")))
        start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("rows"))

        def one(s: Column, p: Column) -> Column:
            total = p["row"] + p["row"].bitwiseAND(p["hit"]) + s["carry"]
            new = total.bitwiseAND(full).bitwiseOR(p["row"].bitwiseAND(F.bitwise_not(p["hit"])))
            return F.struct(F.shiftrightunsigned(total, BLOCK).alias("carry"), F.concat(s["rows"], F.array(new)).alias("rows"))

        return F.aggregate(pairs, start, one)["rows"]

    rows = F.aggregate(bound(blocks, lambda all_: F.transform(characters(b), lambda c: F.transform(all_, lambda m: of(m, c)))), F.transform(starts, lambda _: ones), long_step)
    long_length = F.aggregate(rows, F.lit(0), lambda n, row: n + F.lit(BLOCK) - F.bit_count(row))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.length(a) <= BLOCK, short_length).otherwise(long_length))


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """100 * 2 * LCS / (|a| + |b|); 100 for two empty strings."""
    a, b = col(a), col(b)
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / both)


def without(c: Column | str, n: int, distinct: bool = True) -> Column:
    """The strings that are left if ``n`` (0, 1 or 2) characters are taken out.

    Of a run of equal characters the first ones go, so few strings come twice; none does if ``distinct``.
    """
    c = col(c)
    size = F.length(c)
    left, right = (lambda i: F.substr(c, F.lit(1), i - 1)), (lambda i: F.substr(c, i + 1, size))
    repeats = lambda i: F.substr(c, i, F.lit(1)) == F.substr(c, i - 1, F.lit(1))
    none, once = F.array().cast("array<string>"), F.array_distinct if distinct else (lambda x: x)
    if n == 0:
        return F.array(c)
    if n == 1:
        places = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | ~repeats(i))
        return F.when(size > 0, once(F.transform(places, lambda i: F.concat(left(i), right(i))))).otherwise(none)
    firsts = F.filter(F.sequence(F.lit(1), size - 1), lambda i: (i == 1) | ~repeats(i))
    seconds = lambda i: F.filter(F.sequence(i + 1, size), lambda j: (j == i + 1) | ~repeats(j))
    two = F.transform(firsts, lambda i: F.transform(seconds(i), lambda j: F.concat(left(i), F.substr(c, i + 1, j - i - 1), right(j))))
    return F.when(size > 1, once(F.flatten(two))).otherwise(none)
