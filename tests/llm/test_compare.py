"""Groups of equal first digits are compared many at once, with the spans of a loop over pairs of members."""

import random

import pyarrow as pa

from fleetlake.llm import suffix_dedup as sd

TYPES = {"h": pa.int64(), "key": pa.int64(), "pos": pa.int32(), "witness": pa.bool_(), "before": pa.binary(), "after": pa.binary()}


def rows_of(sizes):
    draw, rows = random.Random(3), []
    for h, size in enumerate(sizes):
        base = bytes(draw.choice(b"ab\0") for _ in range(336))
        for j in range(size):
            x = bytearray(base)
            for _ in range(draw.choice((0, 1, 2, 3))):
                x[draw.randrange(336)] = draw.choice(b"abc\0")
            left, right = draw.choice((136, draw.randrange(137))), draw.choice((200, draw.randrange(64, 201)))
            rows.append((h, h * 10_000 + j, draw.randrange(136, 5000), draw.random() < 0.2, bytes(x[136 - left : 136]), bytes(x[136 : 136 + right])))
    return rows


def compared(rows):
    table = pa.table({c: pa.array(v, t) for (c, t), v in zip(TYPES.items(), zip(*rows, strict=True), strict=True)})
    return {(r["key"], p) for b in sd._compare(200)(iter(table.to_batches(50))) for r in b.to_pylist() for p in range(r["lo"], r["hi"] + 1)}


def test_spans_are_those_of_all_pairs(monkeypatch):
    rows = rows_of([1, 2, 2, 3, 9, 2, 3, 1, 30, 2])
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and not a[3]:
                left = next((i for i, (x, y) in enumerate(zip(a[4][::-1], b[4][::-1], strict=False)) if x != y), min(len(a[4]), len(b[4])))
                right = next((i for i, (x, y) in enumerate(zip(a[5], b[5], strict=False)) if x != y), min(len(a[5]), len(b[5])))
                want |= {(a[1], a[2] - d) for d in range(max(0, 200 - right), left + 1)}
    assert compared(rows) == want
    for pairs, held in ((1, 1), (50, 7)):
        monkeypatch.setattr(sd, "PAIRS", pairs)
        monkeypatch.setattr(sd, "HELD", held, raising=False)
        assert compared(rows) == want


def test_small_groups_take_few_steps(monkeypatch):
    calls = []
    monkeypatch.setattr(sd, "_common", lambda *a, f=sd._common: (calls.append(1), f(*a))[1])
    compared(rows_of([2] * 500))
    assert len(calls) < 50
