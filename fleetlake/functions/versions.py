"""Version strings as comparable keys (PEP 440), in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = (
    r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_LAST = "9" * 30


def parse_version(c: Column) -> Column:
    """A struct that orders like the version it was parsed from; null if the text is no version.

    4.32 and 4.32.0 are equal: trailing zeros of the release are dropped. A release without pre-,
    post- or dev part stands after its pre-releases; dev comes before all, post after.
    """
    text = F.lower(F.trim(c))
    part = lambda i: F.regexp_extract(text, _PATTERN, i)
    number = lambda x: F.when(x == "", F.lit(0)).otherwise(x).cast("decimal(38,0)")
    release = F.transform(F.split(part(2), r"\."), lambda x: x.cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    kept = F.aggregate(
        F.reverse(release),
        F.array().cast("array<decimal(38,0)>"),
        lambda acc, x: F.when((F.size(acc) == 0) & (x == zero), acc).otherwise(F.concat(acc, F.array(x))),
    )
    pre, dev = part(3), part(8)
    post = F.when(part(5) != "", number(part(5))).when(part(6) != "", number(part(7))).otherwise(F.lit(-1).cast("decimal(38,0)"))
    rank = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2).when((post < 0) & (dev != ""), -1).otherwise(3)
    local = F.transform(
        F.when(part(10) == "", F.array().cast("array<string>")).otherwise(F.split(part(10), "[-_.]")),
        lambda x: F.struct(
            x.rlike(r"^\d+$").alias("is_number"),
            F.coalesce(x.try_cast("decimal(38,0)"), zero).alias("number"),
            F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("text"),
        ),
    )
    key = F.struct(
        number(part(1)).alias("epoch"),
        F.reverse(kept).alias("release"),
        F.struct(rank.alias("rank"), F.when(pre != "", number(part(4))).otherwise(zero).alias("n")).alias("pre"),
        post.alias("post"),
        F.when(dev != "", number(part(9))).otherwise(F.lit(_LAST).cast("decimal(38,0)")).alias("dev"),
        local.alias("local"),
    )
    return F.when(text.rlike(_PATTERN), key)
