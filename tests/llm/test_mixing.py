import re

import numpy as np
import pytest

from fleetlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by source: shares by weight, what is over a limit shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


def check(df, rows, off):
    """Sizes, targets and limits by hand; ``off`` bounds a source's distance from its target by its share and its largest text."""
    out = df.collect()
    assert sorted((r.id is None, r.id or 0, r.size) for r in out) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = water(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        times = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(times + 1e-9) <= r.copies <= int(times + 1e-9) + 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(off * target[s], largest[s] / 2 + 1e-6), s
    return out


def test_whole_table(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    once = check(mixing.mix(docs), rows, 0.02)
    again = mixing.mix(docs.repartition(9)).collect()
    assert {(r.id, r.copies) for r in once} == {(r.id, r.copies) for r in again}


def test_many_rows_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 40)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), "w " * int(n), None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}") for i, n in enumerate(rng.geometric(0.02, 6000))]
    rows += [(i, "w " * 5000, "hot") for i in (-1, -2)]
    out = check(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)), rows, 0.005)
    for s in {r.source for r in out}:  # the number of documents is balanced too
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) < 2


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    check(mixing.mix(odd.withColumnRenamed("kept", "size").withColumnRenamed("n_words", "rank")), rows, 0.3)
    assert mixing.mix(empty).collect() == []
    wordless = odd.where("text is null or trim(text) = ''")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(wordless).collect()} == {(0, 0.0, 0)}
    long = spark.createDataFrame([(1, "word " * 4_000_000, "a"), (2, "x y", "b"), (2, "x y", "b")], "doc_id long, text string, source string")
    check(mixing.mix(long), [tuple(r) for r in long.collect()], 1)


def test_probabilities_and_totals_hold():
    """One flight and landing, many seeds: totals stay near and each unit is taken about as often as its probability says."""
    sizes, p = [int(x) for x in np.random.default_rng(2).integers(1, 300, 60)], 0.3
    hits = np.zeros(60)
    for seed in range(400):
        rng, units, done = np.random.default_rng(seed), [], []
        for i in np.random.default_rng(seed).permutation(60):
            units.append((p, sizes[i], int(i)))
            if len(units) > 1:
                fresh, units = mixing._draw(rng, units)
                done += fresh
        assert sum(q for q, _, _ in done + units) == pytest.approx(18) and sum(q * s for q, s, _ in done + units) == pytest.approx(p * sum(sizes))
        for q, _, i in done + mixing._land(rng, units):
            hits[i] += q
    assert np.abs(hits / 400 - p).max() < 0.11
