"""Titles matched to catalog apps: by code, by exact name, by fuzzy name; each step on the remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, normalize_name
from ..sources.storage import saved
from .fuzzy import similar_names

#: Titles that are never matched.
IGNORED_TITLES = ("Apple macOS *", "Oracle Java SE *", "Eclipse Temurin *", "Apple Safari", "Apple Xcode", "Microsoft Visual Studio", "Adobe *", "Jamf *")
FETCHABLE = ("installomator", "homebrew_cask")
#: Slugs of a code that are written title by title before the next ones; results do not depend on it.
RUN = 256


def drop_ignored(titles: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Titles that no glob, built-in or given, fits (case counts)."""
    any_of = "|".join(f"(?:{glob_pattern(p)})" for p in [*IGNORED_TITLES, *(patterns or [])])
    return titles.where(~F.coalesce(F.col("title").rlike(any_of), F.lit(False)))


def candidate_apps(apps: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Apps, one for each slug, that carry an enabled source whose label can be fetched."""
    wanted = [s for s in FETCHABLE if enabled is None or s in enabled]
    return apps.where(F.arrays_overlap("sources", F.array(*map(F.lit, wanted)).cast("array<string>"))).dropDuplicates(["slug"])


def match_by_code(titles: DataFrame, code_index: DataFrame, slugs: DataFrame) -> DataFrame:
    """(title_id, pos, slug): the available slugs of each title's code; code_index is (code, slugs).

    Slugs that are not available leave the index before titles meet it, so the result, which grows with titles times slugs of a code, is not shuffled.
    It comes by code and by runs of RUN slugs, for all titles of the code: a file then repeats a short list of slugs over and over, which
    column formats store in little room. The titles of one code are held in memory, or spilled, beside a run.
    """
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = code_index.select("code", F.posexplode("slugs").alias("pos", "slug")).join(slugs.select("slug"), "slug", "left_semi")
    index = index.groupBy("code", F.floor(F.col("pos") / RUN).alias("run")).agg(F.collect_list(F.struct("pos", "slug")).alias("found"))
    titles = titles.select("title_id", F.col("name_id").alias("code")).where("code is not null")
    hit = index.repartition(parts, "code").join(titles.repartition(parts, "code").hint("merge"), "code")
    return hit.select("title_id", F.explode("found").alias("f")).select("title_id", "f.pos", "f.slug")


def match_direct(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """(title_id, pos, slug) for (title_id, pos, app_name): names that are a slug in lower case, or once normalised.

    Distinct by title; pos orders by name, then lower case before normalised.
    """
    forms = F.array(F.struct(F.lit(0).alias("kind"), F.lower("app_name").alias("slug")), F.struct(F.lit(1).alias("kind"), normalize_name("app_name").alias("slug")))
    df = names.select("title_id", "pos", F.explode(forms).alias("f")).select("title_id", (F.col("pos") * 2 + F.col("f.kind")).alias("pos"), "f.slug")
    return df.join(slugs.select("slug"), "slug").groupBy("title_id", "slug").agg(F.min("pos").alias("pos")).select("title_id", "pos", "slug")


def match_fuzzy(names: DataFrame, slugs: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(title_id, pos, slug): the best slug of each lower-cased name."""
    low = names.select("title_id", "pos", F.lower("app_name").alias("name"))
    hit = low.join(similar_names(low, slugs, threshold), "name")
    return hit.groupBy("title_id", "slug").agg(F.min("pos").alias("pos")).select("title_id", "pos", "slug")


def second_pass(titles: DataFrame, slugs: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(title_id, pos, slug): a title's normalised name as a slug, else the best fuzzy one."""
    df = saved(titles.select("title_id", normalize_name("title").alias("name")).where("name <> ''"), "titles")
    exact = df.join(slugs.select(F.col("slug").alias("name")).distinct(), "name", "left_semi").select("title_id", F.lit(0).alias("pos"), F.col("name").alias("slug"))
    rest = df.join(exact.select("title_id"), "title_id", "left_anti")
    fuzzy = rest.join(similar_names(rest, slugs, threshold), "name").select("title_id", F.lit(0).alias("pos"), "slug")
    return exact.union(fuzzy)


def attach_sources(matches: DataFrame, apps: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """(title_id, sources): the matched slugs under every enabled source that their app carries, in match order."""
    df = matches.join(apps.select("slug", "sources"), "slug").select("title_id", "pos", "slug", F.explode("sources").alias("source"))
    if enabled is not None:
        df = df.where(F.col("source").isin(*enabled))
    one = df.groupBy("title_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"]).alias("slugs"))
    one = one.withColumn("slugs", F.array_distinct("slugs"))
    return one.groupBy("title_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "slugs")))).alias("sources"))


def enrich_native_ids(sources: DataFrame, apps: DataFrame) -> DataFrame:
    """(title_id, sources) with recipe slugs as their distinct repositories and installer slugs as installer titles; slugs stay where nothing is found."""
    long = sources.select("title_id", F.explode("sources").alias("source", "slugs")).select("title_id", "source", F.posexplode("slugs").alias("pos", "slug"))
    ids = F.when(F.col("source") == "autopkg", F.transform("recipe_detail", lambda r: r["repo"])).when(F.col("source") == "jamf_app_installer", F.array("installer_detail.title"))
    found = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    df = long.join(apps.select("slug", "recipe_detail", "installer_detail"), "slug", "left").withColumn("ids", found)
    one = df.groupBy("title_id", "source").agg(F.array_sort(F.collect_list(F.struct("pos", "slug", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")))).alias("rows"))
    names = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["ids"])))
    one = one.select("title_id", "source", F.when(F.size(names) > 0, names).otherwise(F.transform("rows", lambda r: r["slug"])).alias("names"))
    return one.groupBy("title_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "names")))).alias("sources"))


def unmatched(titles: DataFrame, names: DataFrame, matches: DataFrame) -> DataFrame:
    """(title_id, title, app_names): titles without a match, those without app names included."""
    listed = names.groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "app_name"))), lambda x: x["app_name"]).alias("app_names"))
    left = titles.select("title_id", "title").join(matches.select("title_id"), "title_id", "left_anti")
    return left.join(listed, "title_id", "left").withColumn("app_names", F.coalesce("app_names", F.array().cast("array<string>")))


def match_titles(titles: DataFrame, names: DataFrame, apps: DataFrame, code_index: DataFrame, enabled: list[str] | None = None, ignored: list[str] | None = None, threshold: float = 85.0) -> DataFrame:
    """(title_id, step, pos, slug): code, direct, fuzzy, then the second pass, each on the titles still without a match.

    Feed the result to attach_sources and enrich_native_ids; the number of its titles is the updated count.
    """
    slugs = saved(candidate_apps(apps, enabled).select("slug"), "slugs")
    live = saved(drop_ignored(titles, ignored), "live")
    named = saved(names.join(live.select("title_id"), "title_id", "left_semi"), "names")
    steps = (
        ("code", lambda titles, names: match_by_code(titles, code_index, slugs)),
        ("direct", lambda titles, names: match_direct(names, slugs)),
        ("fuzzy", lambda titles, names: match_fuzzy(names, slugs, threshold)),
        ("second pass", lambda titles, names: second_pass(titles, slugs, threshold)),
    )
    out = None
    for step, match in steps:
        found = saved(match(live, named).select("title_id", F.lit(step).alias("step"), "pos", "slug"), "matches")
        done = found.select("title_id").distinct()
        live, named = (df.join(done, "title_id", "left_anti") for df in (live, named))
        out = found if out is None else out.union(found)
    return out.select("title_id", "step", "pos", "slug")
