from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlake.llm.sharding import SNAP, shard_by_bytes


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_shards_are_whole_gapless_and_balanced(request, table):
    df = request.getfixturevalue(table)
    rows = shard_by_bytes(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, size(r.text)) for r in df.select("doc_id", "text").collect())
    slots, total = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if table == "docs":
        target, most = sum(total.values()) / 8, max(r["size"] for r in rows)
        assert all(abs(total[k] - target) <= most + 0.01 * target for k in range(8))


def brute(rows, shards=8):
    """(doc_id, shard, slot) in order of digest and id; cuts at equal targets, moved to the edge of a group of equal texts that is near."""
    ends = []
    at = 0
    for r in rows:
        at += r["size"]
        ends.append(at)
    cuts = [at * k // shards for k in range(1, shards)]
    for i, c in enumerate(cuts):
        j = next(j for j, e in enumerate(ends) if e >= c)
        same = [k for k in range(len(rows)) if rows[k]["digest"] == rows[j]["digest"]]
        edges = (ends[same[0]] - rows[same[0]]["size"], ends[same[-1]])
        near = min(edges, key=lambda e: abs(e - c))
        cuts[i] = near if abs(near - c) <= SNAP * at / shards else c
    out, slots = [], Counter()
    for r, e in zip(rows, ends, strict=True):
        shard = sum(c <= e - (r["size"] + 1) // 2 for c in cuts)
        out.append((r["doc_id"], shard, slots[shard]))
        slots[shard] += 1
    return out


def test_shards_and_slots_agree_with_brute_force(docs):
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).alias("size"), F.xxhash64(text).alias("digest")).orderBy("digest", "doc_id").collect()
    got = shard_by_bytes(docs).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
