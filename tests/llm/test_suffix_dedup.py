import hashlib
from collections import Counter

import pytest

from fleetlake.llm import suffix_dedup
from fleetlake.llm.suffix_dedup import remove_repeats


def brute(texts, size=200):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                cover[i : i + size] = b"\1" * size
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        yield len(t), sum(cover), sum(1 for i in range(len(t)) if cover[i] and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("group", [2048, 3])
def test_removal_agrees_with_brute_force(request, monkeypatch, table, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    df = request.getfixturevalue(table)
    got = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_own_columns_stay(odd):
    out = remove_repeats(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.where("n_removed = 0 and text <> kept_text").isEmpty()
