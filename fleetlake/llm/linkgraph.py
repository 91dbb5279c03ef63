"""URL filtering by rules and by trust and distrust spread over the graph of host links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small

DAMPING = 0.85
#: Rank spreads until what one round adds, over all hosts, is below this share of one seed's mass.
TOLERANCE = 1e-6
#: A host without a rule is blocked if it has more distrust than this share of one seed's mass, and more of it than of trust.
MIN_DISTRUST = 1e-4
#: Rounds whose additions are kept as separate tables before they are summed.
FOLD = 16
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What stands between the host and the next ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    own = (F.col("host") == host) | F.col("host").endswith("." + host)
    return own & F.col("path").startswith(slash + path)


def match_rule(rules: dict[str, str]) -> Column:
    """The longest rule that fits (host, path), as struct(rule, verdict); of equally long ones the first by name."""
    order = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(_fits(r), F.struct(F.lit(r).alias("rule"), F.lit(rules[r]).alias("verdict"))) for r in order))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): the share of a host's outgoing links with a host (//host/... too) that goes to each other host."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("url"))
    links = links.select("src", url_host(F.regexp_replace("url", "^//", "http://")).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): every host of ``seeds`` (host) has mass 1 of its own, and DAMPING of a host's rank follows ``edges`` (src, dst, weight).

    A seed's mass is 1 however many there are, so ranks do not depend on hosts that no link path joins
    to a host. Each round adds up what the last round's additions send over links (summed before the
    shuffle). A round adds at most DAMPING times what the last one added, so the rounds end, and what
    is left out is below tolerance * DAMPING / (1 - DAMPING) in all.
    """
    added = seeds.select("host", F.lit(1.0).alias("rank"))
    parts = [added]
    while True:
        flow = edges.join(added, edges["src"] == added["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("weight") * F.col("rank") * DAMPING).alias("rank"))
        added = saved(flow, "flow")
        total = added.agg(F.sum("rank")).first()[0] or 0.0
        parts.append(added)
        if total < tolerance or len(parts) > FOLD:
            whole = saved(reduce(DataFrame.union, parts).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
            discard(*(p for p in parts[1:] if p is not added))
            parts = [whole]
        if total < tolerance:
            return parts[0]


def judge_pages(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page.

    The longest rule that fits a url decides; a rule fits its host and subdomains if the path starts
    with the rule's. Elsewhere the host decides: trust spreads along links from hosts that an allow
    rule fits on some page, distrust against them from hosts with a blocked page (who links to a bad
    host is suspect), in units of one seed's mass for both; a host is blocked if its distrust exceeds
    MIN_DISTRUST and its trust, whatever the size of the table. Null urls
    and urls without :// have empty host and path, no rule, and are allowed, as is any host that
    neither reaches. Null html has no links; repeated rows count their links again, which leaves the
    shares as they are; a table without links or seeds spreads nothing, an empty one gives no rows. Equal
    trust and distrust allow. Columns other than id, url and html are not read, so clashing names do no harm.
    """
    match = match_rule(rules)
    df = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    hosts = saved(df.withColumn("m", match).groupBy("host").agg(F.max(F.col("m.verdict") == "allow").alias("good"), F.max(F.col("m.verdict") == "block").alias("bad")).where("host <> ''"), "hosts")
    edges = saved(host_links(df), "links")
    ranks = []
    for kind, graph, name in (("good", edges, "trust"), ("bad", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "distrust")):
        if kind == "bad":
            total = graph.groupBy("src").agg(F.sum("weight").alias("total"))
            graph = saved(graph.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight")), "reversed")
        ranks.append(personalised_rank(graph, hosts.where(kind).select("host")).withColumnRenamed("rank", name))
    known = saved(reduce(lambda a, b: a.join(b, "host", "full_outer"), ranks), "ranks")
    out = df.join(small(known), "host", "left").withColumn("m", match)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust > MIN_DISTRUST) & (distrust > trust), "block").otherwise("allow")
    return out.select(id_col, "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
