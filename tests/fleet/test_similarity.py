import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlake.functions import similarity
from fleetlake.functions.helpers import lcs_length
from fleetlake.operators import fuzzy


def test_common_subsequence_on_any_text(spark):
    draw = random.Random(5)
    letters = "abcde éß中\U0001f600\U0001f601𝒳"
    text = lambda k: "".join(draw.choices(letters[: draw.randint(1, len(letters))], k=k))
    pairs = [(text(draw.choice((0, 1, 5, 20, 61, 62, 63, 64, 124, 125, 200))), text(draw.choice((0, 1, 5, 20, 61, 62, 63, 130)))) for _ in range(150)]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    out = df.select("a", "b", similarity.lcs_length("a", "b").alias("n"), similarity.indel_ratio("a", "b").alias("ratio"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.a is None or r.b is None:
            assert r.n is None and r.ratio is None
        else:
            assert r.n == lcs_length(r.a, r.b)
            assert r.ratio == (200.0 * r.n / (len(r.a) + len(r.b)) if r.a or r.b else 100.0)


def test_characters_left_out(spark):
    texts = ["abca", "a", "", "aaaa", "aabb", "abab", "aab", "baa", "\U0001f600x\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", *(similarity.without("c", k).alias(f"w{k}") for k in (0, 1, 2)), *(similarity.without("c", k, False).alias(f"all{k}") for k in (0, 1, 2)))
    for r in df.collect():
        for k in (0, 1, 2):
            assert set(r[f"all{k}"]) == set(r[f"w{k}"])
            assert sorted(r[f"w{k}"]) == sorted({"".join(x) for x in combinations(r.c, len(r.c) - k)} if len(r.c) >= k else [])


@given(st.text("abc", min_size=1, max_size=14), st.data(), st.sampled_from([70, 80, 85, 95]))
@settings(max_examples=400, deadline=None)
def test_some_segment_stands_where_the_plan_looks(slug, data, threshold):
    """Whatever d + 1 segments of a slug are kept, one of them is found in every name that reaches the threshold."""
    name = slug
    for _ in range(data.draw(st.integers(0, 4))):
        i = data.draw(st.integers(0, len(name)))
        name = name[:i] + data.draw(st.sampled_from(["", "a", "b", "c"])) + name[i + data.draw(st.integers(0, 1)) :]
    n, m = len(name), len(slug)
    if not n or 200.0 * lcs_length(name, slug) / (n + m) < threshold:
        return
    d = fuzzy.distance(n, m, threshold)
    assert n + m - 2 * lcs_length(name, slug) <= d
    plan = fuzzy.segment_plan(n, m, d)
    kept = data.draw(st.permutations(plan))[: d + 1]
    assert any(slug[s : s + size] == name[at : at + size] for *_, s, size, first, last in kept for at in range(first, last + 1))


def test_candidates_follow_the_matches(spark):
    """A catalog of numbered slugs: pairs that are looked at grow with the names, not with names times slugs."""
    seen = []
    for k in (200, 2000):
        slugs = spark.range(k).select(F.concat(F.lit("application"), F.col("id") + 10_000).alias("slug"))
        names = spark.range(k).select(F.concat(F.lit("application "), F.col("id") + 10_000).alias("name"))
        seen.append(fuzzy.close_pairs(names, slugs, 85.0).count())
        best = fuzzy.similar_names(names, slugs)
        assert best.count() == k and best.where("substring(name, 13) <> substring(slug, 12)").count() == 0
    assert seen[1] < 15 * seen[0]


def test_thresholds_that_join_everything_are_refused(spark):
    df = spark.createDataFrame([("a", "a")], "name string, slug string")
    with pytest.raises(ValueError):
        fuzzy.similar_names(df, df, 66)


def test_strings_with_characters_left_out_are_not_broadcast(spark):
    """Their tables look small to Spark, what is left of the strings is not."""
    names = spark.range(2000).select(F.concat(F.lit("application "), "id").alias("name"))
    slugs = spark.range(2000).select(F.concat(F.lit("application"), "id").alias("slug"))
    for taken_out in (fuzzy.FIRST, fuzzy.SECOND):
        plan = fuzzy.close_pairs(names, slugs, 85.0, taken_out)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_numbered_names_are_not_scored_against_all_slugs_of_their_letters(spark, monkeypatch):
    """Strings that end in their number need no score, and pairs that share only letters are never made."""
    scored, met = [], []
    monkeypatch.setattr(fuzzy, "_scored", lambda pairs, threshold, f=fuzzy._scored: (scored.append(pairs.count()), f(pairs, threshold))[1])
    monkeypatch.setattr(fuzzy, "_best", lambda pairs, f=getattr(fuzzy, "_best", None): (met.append(pairs.count()), f(pairs))[1], raising=False)
    kind = F.element_at(F.array(*map(F.lit, ("hotplate", "redanvil", "coldwidget", "oldwidget"))), (F.col("id") % 4 + 1).cast("int"))
    for k in (300, 3000):
        names = spark.range(k).select(F.concat(kind, F.col("id") * 14 + 100_001).alias("name"))
        slugs = spark.range(k).select(F.concat(kind, F.col("id") * 14 + 2_000_000).alias("slug"))
        fuzzy.similar_names(names, slugs).count()
        scored.append(-sum(met))
        met.clear()
    pairs = [x for x in scored if x < 0]
    assert not [x for x in scored if x > 0]
    assert -pairs[1] < 40 * 3000


@pytest.mark.parametrize(("kinds", "digits"), [(1024, 12), (3, 5), (0, 12)])
def test_kinds_miss_no_pair(spark, kinds, digits, monkeypatch):
    """Digits before, within and after the letters, and none; all strings by kind, some, and none."""
    monkeypatch.setattr(fuzzy, "KINDS", kinds)
    monkeypatch.setattr(fuzzy, "CROWD", 2)
    monkeypatch.setattr(fuzzy, "DIGITS", digits)
    draw = random.Random(kinds)

    def text():
        letters, number = draw.choice(["hotrod", "oldrod", "hot rod", "é-", "app", "app ", ""]), "".join(draw.choices("0123", k=draw.choice((0, 1, 4, 5, 6))))
        at = draw.choice((len(letters), len(letters), draw.randint(0, len(letters))))
        return letters[:at] + number + letters[at:]

    names, slugs = ({text() for _ in range(120)} for _ in range(2))
    df = lambda rows, c: spark.createDataFrame([*((x,) for x in rows), (None,)], f"{c} string")
    got = {(r.name, r.slug, r.ratio) for r in fuzzy.similar_names(df(names, "name"), df(slugs, "slug")).collect()}
    ratio = lambda a, b: 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0
    best = {n: min((-ratio(n, s), s) for s in slugs) for n in names}
    assert got == {(n, s, -r) for n, (r, s) in best.items() if -r >= 85}


def test_names_whose_letters_are_far_from_all_slugs_are_not_joined(spark, monkeypatch):
    """The second pass of f10: titles against app12 and cask-12; the kinds alone tell that nothing matches."""
    joined = []
    for step in ("close_pairs", "kind_pairs"):
        monkeypatch.setattr(fuzzy, step, lambda *a, f=getattr(fuzzy, step, None), **k: (joined.append(f), f(*a, **k))[1], raising=False)
    names = spark.range(500).select(F.concat(F.lit("hotplate"), F.col("id") + 1000).alias("name"))
    slugs = spark.range(500).select(F.concat(F.element_at(F.array(F.lit("app"), F.lit("cask-")), (F.col("id") % 2 + 1).cast("int")), F.col("id") + 1000).alias("slug"))
    assert fuzzy.similar_names(names, slugs).count() == 0
    assert not joined
