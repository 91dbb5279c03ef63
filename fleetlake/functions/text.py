"""Column functions over names, values, dates and percentages; all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL = 2000
MAX_VERSION = 60


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(c: Column | str) -> Column:
    """Lower-cased, without all but a-z and 0-9; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def blank_to_null(c: Column | str) -> Column:
    """Empty strings count as absent."""
    return F.nullif(col(c), F.lit(""))


def half_even(c: Column | str, digits: int = 2) -> Column:
    """The double scaled by 10**digits, rounded to the nearest whole number (ties to even) and scaled back."""
    return F.rint(col(c).cast("double") * F.lit(10.0**digits)) / F.lit(10.0**digits)


def mean_of_hundredths(c: Column | str) -> Column:
    """An aggregate: the mean of values of at most two decimals, exact in whole hundredths, ties to even; so the order of rows does not matter."""
    total, n = F.sum(F.round(col(c) * 100).cast("long")), F.count(col(c))
    whole, rest = F.floor(F.abs(total) / n), F.abs(total) % n
    up = (2 * rest > n) | ((2 * rest == n) & (whole % 2 == 1))
    return F.when(n > 0, F.signum(total) * (whole + up.cast("long")) / 100)


def percent_text(c: Column | str) -> Column:
    """'12.50%', rounded half-even."""
    return F.concat(half_even(c).cast("decimal(18,2)").cast("string"), F.lit("%"))


def released_at(c: Column | str) -> Column:
    """The time of a display date ('Jan 05 2024'; one- or two-digit day, any case); null if it does not parse."""
    return F.try_to_timestamp(F.initcap(col(c)), F.lit("MMM d yyyy"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a case-sensitive glob of *, ? and [...]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def is_shell_expression(c: Column | str) -> Column:
    """Contains $( or ${, or starts with $; null is not one."""
    c = col(c)
    return F.coalesce(c.contains("$(") | c.contains("${") | c.startswith("$"), F.lit(False))


def is_clean_url(c: Column | str) -> Column:
    """One line of at most MAX_URL characters that starts with http:// or https://."""
    c = col(c)
    ok = ~c.rlike(r"[\r\n]") & (F.length(c) <= MAX_URL) & (c.startswith("http://") | c.startswith("https://"))
    return F.coalesce(ok, F.lit(False))


def is_clean_version(c: Column | str) -> Column:
    """A non-blank line of at most MAX_VERSION characters with a digit and without < and >."""
    c = col(c)
    ok = (F.trim(c) != "") & ~c.rlike(r"[\r\n<>]") & (F.length(c) <= MAX_VERSION) & c.rlike(r"\p{Nd}")
    return F.coalesce(ok, F.lit(False))


def classify_value(c: Column | str, kind: str) -> Column:
    """struct(status, reason) of a literal value of kind 'url' or 'version': resolved, unresolvable or invalid."""
    c = col(c)
    clean = {"url": is_clean_url, "version": is_clean_version}[kind](c)
    made = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(c.isNull() | (F.trim(c) == ""), made("unresolvable", "empty"))
        .when(is_shell_expression(c), made("unresolvable", "shell expression"))
        .when(~clean, made("invalid", f"not a clean {kind}"))
        .otherwise(made("resolved", None))
    )


def version_from_tag(c: Column | str) -> Column:
    """The digits and dots of a release tag; null if there are none."""
    return blank_to_null(F.regexp_replace(col(c), r"[^0-9.]", ""))


def first_scalar(values: Column | str) -> Column:
    """The first assignment of a value list; null if there is none or it is empty."""
    return blank_to_null(F.get(col(values), 0))


def pick_release_asset(assets: Column, archive_name: Column, kind: Column) -> Column:
    """The first asset url that contains the archive name (if set and literal), else the first that ends in '.<type>'."""
    suffix = F.concat(F.lit("."), F.when(kind == "pkgInDmg", "dmg").when(kind == "pkgInZip", "zip").otherwise(kind))
    literal = F.when((archive_name != "") & ~archive_name.startswith("$"), archive_name)
    named = F.get(F.filter(assets, lambda a: a.contains(literal)), 0)
    return F.when(literal.isNotNull() & named.isNotNull(), named).otherwise(F.get(F.filter(assets, lambda a: a.endswith(suffix)), 0))


def json_path_value(json: Column | str, path: str) -> Column:
    """The value at a literal dotted, [n] or ["k"] path; objects as JSON text; null for bad JSON or a missing path."""
    path = re.sub(r"""\[\s*["']([^"']*)["']\s*\]""", r"['\1']", path.strip().lstrip("."))
    return F.get_json_object(col(json), "$" + ("" if path.startswith("[") or not path else ".") + path)


def shell_quote(c: Column | str) -> Column:
    """The value as one shell word."""
    c = col(c)
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(c.rlike(r"^[A-Za-z0-9_@%+=:,./\-]+$"), c).otherwise(quoted)
