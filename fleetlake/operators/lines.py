"""Line filters over a table lines(doc_id, line_no, line); windows share the key doc_id."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import well_formed
from ..sources.storage import numbered


def to_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): lines numbered from 1."""
    return df.select("doc_id", F.posexplode(F.split(text, "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def from_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each document joined again."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _pattern(pattern: str, ignore_case: bool) -> str:
    return f"(?i){pattern}" if ignore_case else pattern


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, only: bool = False, invert: bool = False, every: bool = False) -> DataFrame:
    """Lines that match (or not); with ``only``, the first match of each such line instead of the line.

    With ``every``, each match that is not empty is a line of its own, numbered in ``match_no`` from 0.
    """
    p = _pattern(pattern, ignore_case)
    if only and not invert and not every:
        return lines.where(F.col("line").rlike(p)).withColumn("line", F.regexp_extract("line", p, 0))
    if every and not invert:
        found = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(p), 0)).alias("match_no", "line"))
        return found.where("line <> ''").select("doc_id", "line_no", "match_no", "line")
    hit = F.col("line").rlike(p)
    return lines.where(~hit if invert else hit)


def head(lines: DataFrame, n: int = 10) -> DataFrame:
    return _edge(lines, n, F.asc("line_no"))


def tail(lines: DataFrame, n: int = 10) -> DataFrame:
    return _edge(lines, n, F.desc("line_no"))


def _edge(lines: DataFrame, n: int, order: Column) -> DataFrame:
    return lines.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where(F.col("__r") <= n).drop("__r")


def _ranges(fields: str) -> list[tuple[int, int | None]]:
    out = []
    for part in fields.split(","):
        a, dash, b = part.partition("-")
        out.append((int(a or 1), int(b) if b else (None if dash else int(a))))
    return out


def cut(lines: DataFrame, delimiter: str, fields: str, posix: bool = False) -> DataFrame:
    """The 1-based fields of a list like '3,1,4-6,8-' in the order asked for, joined again; fields beyond the last are left out.

    A line without the delimiter is one field. With ``posix`` fields come once, in the order of the
    line, and a line without the delimiter stays whole.
    """
    parts, wanted = F.split("line", re.escape(delimiter)), _ranges(fields)
    if not posix:
        from_one = [(max(a, 1), b) for a, b in wanted if b is None or b >= max(a, 1)]
        taken = [F.slice(parts, F.lit(a), F.lit(b - a + 1) if b is not None else F.size(parts)) for a, b in from_one]
        joined = F.array_join(F.concat(F.array().cast("array<string>"), *taken), delimiter)
        return lines.withColumn("line", F.when(F.col("line").isNotNull(), joined))
    inside = lambda i: reduce(Column.__or__, [(i >= a) & (i <= b if b is not None else F.lit(True)) for a, b in wanted])
    kept = F.filter(parts, lambda _, i: inside(i + 1))
    return lines.withColumn("line", F.when(F.col("line").contains(delimiter), F.array_join(kept, delimiter)).otherwise(F.col("line")))


def awk_field(lines: DataFrame, n: int, sep: str | None = None) -> DataFrame:
    """The n-th field ($0 is the line); white-space runs part fields by default; a missing field is ''."""
    if n == 0:
        return lines
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ") if sep is None else F.split("line", re.escape(sep))
    return lines.withColumn("line", F.coalesce(F.get(parts, n - 1), F.lit("")))


def sed_sub(lines: DataFrame, pattern: str, replacement: str, all_matches: bool = False) -> DataFrame:
    """The first match, or all, replaced; \\1 names a group and & the match in the replacement."""
    # to replace the first match only, group 1 is what stands before it and group 2 the match itself
    shift, out, i = (0 if all_matches else 2), "", 0
    while i < len(replacement):
        c, after = replacement[i], replacement[i + 1 : i + 2]
        if c == "\\" and after:
            out += f"${int(after) + shift}" if after.isdigit() else "\\" + after
            i += 1
        elif c == "&":
            out += f"${shift}"
        else:
            out += "\\$" if c == "$" else c
        i += 1
    if all_matches:
        return lines.withColumn("line", F.regexp_replace("line", pattern, out))
    return lines.withColumn("line", F.regexp_replace("line", f"(?s)^(.*?)({pattern})", "$1" + out))


def tr(lines: DataFrame, src: str, dst: str) -> DataFrame:
    """Characters translated one for one; sets of unequal length raise."""
    if len(src) != len(dst):
        raise ValueError("both sets must have the same length")
    return lines.withColumn("line", F.translate("line", src, dst))


def tr_delete(lines: DataFrame, src: str) -> DataFrame:
    return lines.withColumn("line", F.translate("line", src, ""))


def sort_lines(lines: DataFrame, reverse: bool = False, numeric: bool = False, ranged: bool = False) -> DataFrame:
    """Lines of each document in order, renumbered; numeric order puts numbers first, then text.

    A document is sorted by one task; with ``ranged`` all lines are dealt by ranges of document and order,
    and numbered from the counts of the ranges, so one of any length is spread over tasks.
    """
    number = F.trim("line").try_cast("double")
    keys = [number.isNull(), number, F.col("line")] if numeric else [F.col("line")]
    order = [k.desc() if reverse else k.asc() for k in keys] + [F.col("line_no").asc()]
    if not ranged:
        return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    rows = numbered(lines, [F.col("doc_id").asc(), *order], "__n")
    first = rows.groupBy(F.col("doc_id").alias("__d")).agg(F.min("__n").alias("__first"))
    out = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__d"))).withColumn("line_no", (F.col("__n") - F.col("__first") + 1).cast("int"))
    return out.select(lines.columns)


def uniq(lines: DataFrame, ranged: bool = False) -> DataFrame:
    """Without lines equal to the one before; ``ranged`` as in ``sort_lines``."""
    if ranged:
        rows = numbered(lines, [F.col("doc_id"), F.col("line_no")], "__n")
        before = rows.select((F.col("__n") + 1).alias("__n"), F.col("doc_id").alias("__d"), F.col("line").alias("__b"), F.lit(True).alias("__any"))
        met = rows.join(before, "__n", "left")
        own = F.coalesce(F.col("__any"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("__d"))
        return met.where(~own | F.col("__b").isNull() | (F.col("__b") != F.col("line"))).select(lines.columns)
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("__b", before).where("__b is null or __b <> line").drop("__b")


def xpath_values(df: DataFrame, expr: str, xml: str = "xml") -> DataFrame:
    """(…, value): the text of each node that an XPath expression finds, or name="value" for an attribute; bad XML gives no rows.

    A namespaced attribute is written @*[name()="ns:attr"].
    """
    last = expr.rsplit("/", 1)[-1]
    path = expr if last.startswith("@") or last.endswith("text()") else f"{expr}/text()"
    # Spark's xpath stops the job at XML that does not parse, so that is found first
    given = df.withColumn("__ok", well_formed(xml))
    values = F.xpath(F.when(F.col("__ok"), F.col(xml)), F.lit(path))
    out = given.select("*", F.explode(values).alias("value")).drop("__ok")
    if last.startswith("@"):
        m = re.match(r'@\*\[name\(\)\s*=\s*["\']([^"\']+)', last)
        out = out.withColumn("value", F.concat(F.lit(f'{m[1] if m else last[1:]}="'), "value", F.lit('"')))
    return out
