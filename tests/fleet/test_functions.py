import random
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from fleetlake.functions import helpers
from fleetlake.functions import text as x
from fleetlake.functions.versions import parse_version
from fleetlake.operators import lines, matching
from fleetlake.plans import queries
from fleetlake.plans.standins import Tables

WORDS = st.text("abcd ", max_size=14)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_lcs(a, b):
    assert helpers.lcs_length(a, b) == plain_lcs(a, b)


@pytest.mark.parametrize("threshold", [100, 85, 80, 70])
def test_blocking_loses_no_pair(spark, threshold):
    draw = random.Random(4)
    base = ["ab", "xyz", *("".join(draw.choices("abcdefgh12", k=draw.randint(1, 12))) for _ in range(60))]
    edited = [s[:i] + draw.choice(["", "z", "a"]) + s[i + draw.randint(0, 1) :] for s in base for i in (draw.randint(0, len(s)),)]
    names, slugs = sorted(set([*edited, *base[:10], "aXb", "yz"])), sorted(set(base))
    want = {}
    for n in names:
        best = min(((-200.0 * plain_lcs(n, s) / (len(n) + len(s)), s) for s in slugs if n or s), default=None)
        if best and -best[0] >= threshold:
            want[n] = best[1]
    got = matching.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(s,) for s in slugs], "slug string"), threshold)
    assert {r.name: r.slug for r in got.collect()} == want
    with pytest.raises(ValueError):
        matching.similar_names(got, got, 60)


def best_slug(name, slugs, threshold=85):
    best = min(((-200.0 * helpers.lcs_length(name, s) / (len(name) + len(s)), s) for s in slugs if name or s), default=None)
    return best[1] if best and -best[0] >= threshold else None


def test_registered_fuzzy_matches_agree_with_all_pairs(spark):
    """f05 and f06 on the smallest table against every pair."""
    t = Tables(spark, "/root/testdata/sf0.001")
    run = queries.queries()
    slugs = {r.slug for r in queries._slugs(t).select("slug").collect()}
    want = {(r.title_id, s) for r in queries._names(t).collect() if (s := best_slug(r.app_name.lower(), slugs))}
    assert {(r.title_id, r.slug) for r in run["f05_match_fuzzy"](spark, "/root/testdata/sf0.001").collect()} == want
    flat = lambda x: "".join(c for c in (x or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    slugs = {flat(r.name) for r in t.casks.collect()}
    want = {(r.title_id, n if n in slugs else s) for r in t.titles.collect() if (n := flat(r.title)) and (n in slugs or (s := best_slug(n, slugs)))}
    assert {(r.title_id, r.slug) for r in run["f06_second_pass"](spark, "/root/testdata/sf0.001").collect()} == want


def test_versions_order_like_pep_440(spark):
    given_ = ["1.0", "1.0.0", "1.0a1", "1.0.dev3", "1.0b2", "1.0rc1", "1.0c2", "1.0.post1", "1.0-1", "1.0+local.2", "1.0+local.10", "v2", "1!0.1", "4.32", "4.32.0", "1.0a1.dev2", "1.0.post1.dev1", "x", "", "latest", "1..2", "0", "1.10", "1.9", "2024.01.05", "1.0alpha", "1.0-preview-3", "1.0r4"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given_)], "i int, v string").select("i", "v", parse_version(F.col("v")).alias("k"))
    parsed = {}
    for v in given_:
        try:
            parsed[v] = Version(v)
        except InvalidVersion:
            pass
    assert {r.v for r in rows.where("k is not null").collect()} == set(parsed)
    order = [r.v for r in rows.where("k is not null").orderBy("k", "i").collect()]
    assert all(parsed[a] <= parsed[b] for a, b in pairwise(order))
    same = rows.alias("a").join(rows.alias("b"), F.col("a.k") == F.col("b.k")).select("a.v", "b.v").collect()
    assert {(a, b) for a, b in same} == {(a, b) for a in parsed for b in parsed if parsed[a] == parsed[b]}


def test_fragments():
    text = """#!/bin/sh
firefox|ff)
    name="Fire fox" # it's
    type='dmg'
    downloadURL=$(curl -fs "https://e/x?a=1" | grep -o 'a;b' |
        head -1)
    appNewVersion=${v}; appNewVersion=`echo "1.0"`
    blocking=( "A b" C # c
      'D' )
    if [ a = b ]; then
        archiveName="x $(echo ")") y"
    fi
    empty=
    ;;
"""
    got = helpers.scan_fragment(text)
    assert {g[0] for g in got} == {"firefox"}
    assert [g[1:] for g in got] == [
        ("name", ["Fire fox"], False), ("type", ["dmg"], False), ("downloadURL", ['$(curl -fs "https://e/x?a=1" | grep -o \'a;b\' |\n        head -1)'], False),
        ("appNewVersion", ["${v}"], False), ("appNewVersion", ['`echo "1.0"`'], False), ("blocking", ["A b", "C", "D"], True), ("archiveName", ['x $(echo ")") y'], False), ("empty", [""], False),
    ]


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_fragments_never_fail(text):
    helpers.scan_fragment(text)


def test_html_entities(spark):
    rows = ["a&amp;b", "&lt;x&gt; &quot;&#39;", "&amp;lt;", "&eacute;&#65;", "plain", "a & b", None]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(helpers.html_unescape(F.col("v"))).collect()
    assert [r[0] for r in got] == ["a&b", "<x> \"'", "&lt;", "éA", "plain", "a & b", None]


def test_value_checks(spark):
    rows = [None, "", " ", "1.2", "$(x)", "a${b}", "$v", "http://a", "ftp://a", "http://a\nb", "no digits", "<1>", "9" * 61, "Build 4200"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string").select(x.is_shell_expression("v"), x.is_clean_url("v"), x.is_clean_version("v"), x.classify_value("v", "version")["status"])
    got = [tuple(r) for r in df.collect()]
    assert [r for r, g in zip(rows, got, strict=True) if g[0]] == ["$(x)", "a${b}", "$v"]
    assert [r for r, g in zip(rows, got, strict=True) if g[1]] == ["http://a"]
    assert [r for r, g in zip(rows, got, strict=True) if g[2]] == ["1.2", "Build 4200"]
    assert got[8][3] == "invalid" and got[4][3] == "unresolvable" and got[13][3] == "resolved"


def test_percentages_round_half_even(spark):
    row = spark.range(1).select(x.percent_text(F.lit(0.125)), x.percent_text(F.lit(83.335)), x.percent_text(F.lit(100.0)), x.percent_text(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("0.12%", "83.34%", "100.00%", None)


def test_line_filters(spark):
    df = spark.createDataFrame([(1, 1, "b  x,1 a"), (1, 2, "a"), (1, 3, "a"), (1, 4, "10"), (1, 5, "9")], "doc_id long, line_no int, line string")
    run = lambda out: [r.line for r in out.orderBy("line_no").collect()]
    assert run(lines.cut(df, ",", "2-,9", posix=True)) == ["1 a", "a", "a", "10", "9"]
    assert run(lines.awk_field(df, 2)) == ["x,1", "", "", "", ""]
    assert run(lines.sed_sub(df, "([ax])", r"[\1&]")) == ["b  [xx],1 a", "[aa]", "[aa]", "10", "9"]
    assert run(lines.sed_sub(df, "([ax])", r"[\1&]", all_matches=True)) == ["b  [xx],1 [aa]", "[aa]", "[aa]", "10", "9"]
    assert run(lines.sort_lines(df, numeric=True)) == ["9", "10", "a", "a", "b  x,1 a"]
    assert run(lines.uniq(df)) == ["b  x,1 a", "a", "10", "9"]
    with pytest.raises(ValueError):
        lines.tr(df, "ab", "c")
