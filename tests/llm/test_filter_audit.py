import re
from itertools import permutations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlake.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = list("ABCDE")


def brute(rows, labels):
    """rows (id, text, lang); labels {id: (good, toxic)}."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids.setdefault(t, set()).add(i)

    def fails(i, t):
        w = WORD.findall(t)
        return {n for n, x in zip(NAMES, (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and min(ids[t]) < i), strict=True) if x}

    table = [(p, fails(i, t), *labels.get(i, (False, False))) for i, t, p in rows]
    out, by_filter = {}, {}
    for part in {r[0] for r in table}:
        own = [r for r in table if r[0] == part]
        for order in permutations(NAMES):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                by_filter[part, f] = by_filter.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(*k, *v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(docs, labels):
    out = fa.interaction_audit(fa.failures(docs, labels), NAMES)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    marks = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in labels.collect()}
    assert run(docs, labels) == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], marks)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1, 0, "x"), (8, 1, 1, "x"), (8, 0, None, "x"), (None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, part string")
    more = odd.union(spark.createDataFrame([(20, "w " * 3_000_000, "en", "s", None, 1), (21, "A#" * 10, None, "s", None, 1)], odd.schema))
    given_ = more.withColumns({"part": F.lit("own"), "A": F.lit(1), "place": F.lit(2)})
    rows = [(r.doc_id, r.text, r.lang) for r in more.collect()]
    assert run(given_, labels) == brute(rows, {7: (True, False), 8: (True, True)})
    assert run(empty, labels) == set()
    assert run(odd, labels.limit(0)) == brute([(r.doc_id, r.text, r.lang) for r in odd.collect()], {})


def test_ranges_of_any_size_add_up(spark, docs, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flags = fa.failures(docs, labels)
    want = {tuple(r) for r in fa.interaction_audit(flags, ["B", "E"]).collect()}
    monkeypatch.setattr(fa, "RANGE_BITS", 3)
    assert {tuple(r) for r in fa.interaction_audit(flags, ["B", "E"]).collect()} == want and len(want) == 4 * 2 * 2


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_merges(a, b):
    x, y = (np.array(sorted(s), np.int32) for s in (a, b))
    assert fa.union(x, y).tolist() == sorted(a | b) and fa.meet_size(x, y) == len(a & b)
