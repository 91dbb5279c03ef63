"""Filters, sorts and top-k over title rows."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import floor_days, released_at

TIES = ("title", "title_id")


def _top(df: DataFrame, *keys: Column, top_n: int | None = None) -> DataFrame:
    out = df.orderBy(*keys, *(F.col(t) for t in TIES))
    return out.limit(top_n) if top_n is not None else out


def sort_titles(df: DataFrame, key: str, chronological: bool = False) -> DataFrame:
    """Ascending by a column named in any case, with spaces or underscores; release dates sort as text unless ``chronological``."""
    name = key.lower().replace(" ", "_")
    if name not in df.columns:
        raise ValueError(f"no such column: {key}")
    return _top(df, released_at(name) if chronological and name == "released" else F.col(name).asc_nulls_last())


def omit_recent(df: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Titles released earlier than ``hours`` before ``as_of``."""
    return df.where(released_at("released") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def most_installed(df: DataFrame, top_n: int | None = None) -> DataFrame:
    return _top(df, F.desc("total_hosts"), top_n=top_n)


def least_installed(df: DataFrame, top_n: int | None = None) -> DataFrame:
    return _top(df, F.asc("total_hosts"), top_n=top_n)


def oldest_least_complete(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """By release date as text, then completion."""
    return _top(df, F.asc("released"), F.asc("completion_percent"), top_n=top_n)


def below_threshold(df: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Completion strictly below ``threshold``, least first."""
    return _top(df.where(F.col("completion_percent") < threshold), F.asc("completion_percent"))


def high_missing(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """More than half of the hosts missing the patch, fewest missing first."""
    return _top(df.where(F.col("missing_patch") > F.col("total_hosts") * 0.5), F.asc("missing_patch"), top_n=top_n)


def recent_release(df: DataFrame, as_of: Column, top_n: int | None = None) -> DataFrame:
    """Released within the week before ``as_of``, by release date as text, descending."""
    return _top(df.where(released_at("released") >= as_of - F.make_dt_interval(F.lit(7))), F.desc("released"), top_n=top_n)


def zero_completion(df: DataFrame) -> DataFrame:
    return df.where("completion_percent = 0")


def top_performers(df: DataFrame, top_n: int | None = None) -> DataFrame:
    return _top(df.where("completion_percent > 90"), F.desc("completion_percent"), top_n=top_n)


def covered_by(token: str) -> Column:
    """Whether a title's ``sources`` map lists anything under the token."""
    return F.coalesce(F.size(F.try_element_at("sources", F.lit(token))) > 0, F.lit(False))


def installomator_covered(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """Titles that an installer label covers, in title order."""
    return _top(df.where(covered_by("installomator")), top_n=top_n)


def impact_weighted_risk(df: DataFrame, as_of: Column, top_n: int | None = None) -> DataFrame:
    """score = missing hosts x days since release (0 at least), highest first; unparseable dates go."""
    days = F.greatest(floor_days(as_of, released_at("released")), F.lit(0))
    return _top(df.where(released_at("released").isNotNull()).withColumn("score", (F.col("missing_patch") * days).cast("long")), F.desc("score"), top_n=top_n)


def coverage_gaps(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """Titles with no source at all, most missing first."""
    return _top(df.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0), F.desc("missing_patch"), top_n=top_n)


def where_titles(df: DataFrame, min_compliance: float | None = None, min_hosts: int | None = None, released_after: str | None = None) -> DataFrame:
    """Titles that meet every given minimum; ``released_after`` is an ISO date, and drops unparseable release dates."""
    if min_compliance is not None:
        df = df.where(F.col("completion_percent") >= min_compliance)
    if min_hosts is not None:
        df = df.where(F.col("total_hosts") >= min_hosts)
    if released_after is not None:
        df = df.where(released_at("released") >= F.lit(date.fromisoformat(released_after)).cast("timestamp"))
    return df


CRITERIA: dict[str, Callable[..., DataFrame]] = {
    f.__name__.replace("_", "-"): f
    for f in (most_installed, least_installed, oldest_least_complete, below_threshold, high_missing, recent_release, zero_completion, top_performers, installomator_covered, impact_weighted_risk, coverage_gaps)
}


def criteria() -> list[str]:
    return list(CRITERIA)


def apply_criterion(df: DataFrame, name: str, where: dict | None = None, **options) -> DataFrame:
    """A criterion by its kebab-case name, after an optional filter; options it does not take are ignored."""
    if name not in CRITERIA:
        raise ValueError(f"unknown criterion: {name}")
    unknown = set(where or ()) - set(inspect.signature(where_titles).parameters)
    if unknown:
        raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
    taken = inspect.signature(CRITERIA[name]).parameters
    return CRITERIA[name](where_titles(df, **(where or {})), **{k: v for k, v in options.items() if k in taken and v is not None})
