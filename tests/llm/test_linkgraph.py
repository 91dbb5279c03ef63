import random
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from fleetlake.llm.linkgraph import MIN_DISTRUST, judge_pages, personalised_rank
from fleetlake.llm.queries import URL_RULES


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def seeds(urls):
    """The hosts of urls that an allow rule, a block rule or none decides."""
    of = defaultdict(set)
    for url in urls:
        parts = urlsplit(url)
        rule = rule_of(parts.netloc.lower(), parts.path)
        of[rule and URL_RULES[rule]].add(parts.netloc.lower())
    return of


def verdict(host, path, trust, distrust):
    rule = rule_of(host, path)
    t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
    return URL_RULES[rule] if rule else "block" if d > MIN_DISTRUST and d > t else "allow"


def test_rules_agree_with_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = judge_pages(pages, URL_RULES).join(pages.select("page_id", "url"), "page_id").collect()
    of = seeds([r.url for r in rows])
    for r in rows:
        parts = urlsplit(r.url)
        assert (r.host, r.path, r.rule) == (parts.netloc.lower(), parts.path, rule_of(parts.netloc.lower(), parts.path))
        # these pages link to no host, so ranks stay with the seeds: a host with blocked and no allowed pages is blocked
        assert r.verdict == verdict(r.host, r.path, *(power_iteration({}, of[k]) for k in ("allow", "block")))


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "http://good.org/", link("friend.net")), (2, "http://friend.net/a", link("far.net")), (3, "http://far.net/", None),
        (4, "HTTP://Bad.COM/de/1?q#f", "x"), (5, "http://farm.net/", link("bad.com", "bad.com")), (6, "http://alone.net", ""),
        (7, None, None), (8, "no scheme", ""), (9, "http://", None), (9, "http://", None),
    ]
    out = {r.page_id: r for r in judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert out[2].trust > out[3].trust > 0 and out[2].verdict == "allow"
    assert out[4].host == "bad.com" and out[4].path == "/de/1" and out[4].verdict == "block" and out[4].rule == "com/de/"
    assert out[5].distrust > 0 and out[5].verdict == "block" and out[5].rule is None
    assert out[6].verdict == "allow" and (out[7].host, out[7].path, out[8].host, out[9].host) == ("", "", "", "")


def test_empty_table(spark):
    assert judge_pages(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).collect() == []


def test_verdicts_do_not_depend_on_table_size(spark):
    page = "page_id long, url string, html string"
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [(1, "http://a.com/de/1", ""), (2, "http://a.com/other", ""), (3, "http://near.net/", link("a.com")), (4, "http://good.org/", link("c.net")), (5, "http://c.net/", "")]
    more = spark.range(12_000).selectExpr("id + 100 AS page_id", "concat('http://h', id, '.com/de/x') AS url", "'' AS html")
    few = spark.createDataFrame(rows, page)
    want = {r.page_id: r for r in judge_pages(few, URL_RULES).collect()}
    got = {r.page_id: r for r in judge_pages(few.union(more), URL_RULES).where("page_id < 100").collect()}
    assert got == want and [want[i].verdict for i in (1, 2, 3, 4, 5)] == ["block", "block", "block", "allow", "allow"]


def test_rank_reaches_far_hosts_and_settles(spark):
    chain = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(15)]
    edges = spark.createDataFrame([*chain, ("x", "y", 1.0), ("y", "x", 1.0)], "src string, dst string, weight double").coalesce(1).cache()
    rank = {r.host: r["rank"] for r in personalised_rank(edges, spark.createDataFrame([("h0", 1.0), ("x", 1.0)], "host string, seed double")).collect()}
    assert abs(rank["h15"] - 0.85**15) < 1e-9
    assert abs(rank["x"] - 1 / (1 - 0.85**2)) < 1e-5 and abs(rank["y"] - 0.85 / (1 - 0.85**2)) < 1e-5


def power_iteration(edges, seeds, rounds=400):
    """Ranks by plain iteration: a seed has mass 1, 0.85 of a rank follows the links."""
    rank = {}
    for _ in range(rounds):
        new = defaultdict(float, {s: 1.0 for s in seeds})
        for (src, dst), w in edges.items():
            new[dst] += 0.85 * w * rank.get(src, 0.0)
        rank = new
    return rank


def shares(pairs):
    out = Counter()
    for (src, _), n in pairs.items():
        out[src] += n
    return {(src, dst): n / out[src] for (src, dst), n in pairs.items()}


def test_full_verdict_agrees_with_power_iteration(spark):
    """A random graph with both kinds of seeds, loops, repeated rows, links without a scheme, very long html and clashing columns."""
    draw = random.Random(8)
    hosts = [f"h{i}.net" for i in range(25)] + [f"s{i}.org" for i in range(4)] + [f"b{i}.com" for i in range(5)]
    rows, links = [], Counter()
    for i in range(120):
        host = draw.choice(hosts)
        out = [draw.choice(hosts) for _ in range(draw.randint(0, 4))]
        path = draw.choice(["/de/1", "/fr/x", "/other"]) if host.endswith(".com") else "/a"
        html = "".join(f'<a href="{draw.choice(["http:", "https:", ""])}//{h}/x">' for h in out) + "z" * draw.choice([0, 200_000])
        for _ in range(1 + (i % 10 == 0)):
            rows.append((i, f"http://{host}{path}", html, "clash", 1.5))
            links.update((host, h) for h in out if h != host)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, trust double")
    of = seeds([url for _, url, *_ in rows])
    there = shares(links)
    back = Counter()
    for (src, dst), w in there.items():
        back[dst, src] += w
    trust, distrust = power_iteration(there, of["allow"]), power_iteration(shares(back), of["block"])
    got = judge_pages(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        t, d = trust.get(r.host, 0.0), distrust.get(r.host, 0.0)
        assert (r.trust, r.distrust) == (pytest.approx(t, abs=1e-4), pytest.approx(d, abs=1e-4))
        assert r.verdict == verdict(r.host, r.path, trust, distrust)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_equal_trust_and_distrust_allow(spark):
    rows = [(1, "http://both.com/de/1", ""), (2, "http://both.com/fr/1", ""), (3, "http://both.com/x", "")]
    out = judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES)
    assert [r.verdict for r in out.orderBy(F.col("page_id")).collect()] == ["block", "allow", "allow"]
