from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import partenum
from fleetlake.llm.partenum import Bands, similar_components


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            ids[d].append(i)
    for same in ids.values():
        for i in same[1:]:
            parent[top(i)] = top(same[0])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("n, percent, block", [(3, 90, 384), (5, 80, 2)])
def test_components_agree_with_all_pairs(request, monkeypatch, table, n, percent, block):
    monkeypatch.setattr(partenum, "BLOCK_SETS", block)
    if block < 10:
        monkeypatch.setattr(partenum, "SKETCH_SETS", 3)
        monkeypatch.setattr(partenum, "BATCH", 50)
    df = request.getfixturevalue(table).select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert Counter(map(tuple, similar_components(df, n, percent).collect())) == brute(rows, n, percent)


def test_bands_hold_similar_pairs():
    bands = Bands(90)
    for a in range(1, 400):
        for b in range(a, a * 10 // 9 + 1):
            ja, jb = bands.band(a), bands.band(b)
            assert jb - ja in (0, 1)
            assert bands.distance(jb) >= (a + b) * 10 // 190


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    """Pairs at the very threshold, of many sizes, share a signature of the larger one's band."""
    rng, bands = np.random.default_rng(3), Bands(percent)
    for size in [*range(5, 60), 100, 333, 1200, 5000]:
        common = size * percent // 100
        for extra in {size - common, max(0, common * 100 // percent - size)}:
            x = np.unique(rng.integers(1, 1 << 63, size + extra, dtype=np.uint64))
            a, b = x[rng.permutation(len(x)) < size], None
            keep = np.isin(x, a)
            union = len(x)
            shared = -(-percent * union // 100)  # the least intersection that links
            if shared > len(a):
                continue
            b = np.sort(np.concatenate((x[~keep], rng.permutation(a)[:shared])))
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            band = bands.band(max(len(a), len(b)))
            if bands.distance(band):
                assert bands.band(min(len(a), len(b))) >= band - 1
                assert np.intersect1d(partenum.signatures(a, band, bands), partenum.signatures(b, band, bands)).size


def test_bound_on_signatures():
    for percent in (80, 90):
        bands = Bands(percent)
        for band in range(1, 45):
            n1, k2, n2, slack = bands.plan(band)
            k = bands.distance(band)
            assert (n1 - slack) * (k2 + 1) > k and n1 * len(partenum._subsets(n2, k2)) <= max(16, 1.65 * (k + 1) + 4)


def test_a_shared_passage_makes_no_large_family(spark):
    """Different texts that share one passage of 60 words: compared pairs stay few, no link is made."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([*(word() for _ in range(150)), passage, *(word() for _ in range(150))])) for i in range(300)]
    out = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert out.where(F.col("id") != F.col("component_id")).isEmpty()


def test_links_through_rows_without_an_id(spark):
    """The outer texts are linked only by the middle one, which has no id."""
    words = [f"w{i}" for i in range(300)]
    texts = [words[:280], words[10:290], words[20:]]
    for ids, want in (((1, 2, 3), {1}), ((1, None, 3), {1}), ((None, 5, None), {5}), ((None, None, None), {None})):
        rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
        got = similar_components(spark.createDataFrame([*rows, (9, "x y z"), (None, None)], "doc_id long, text string"), n=3, percent=90)
        assert {r.component_id for r in got.collect() if r.n_shingles > 100} == want
        assert sorted((r.id, r.component_id) for r in got.collect() if r.id == 9) == [(9, 9)]
