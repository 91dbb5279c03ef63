import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlake.llm import alignment as al

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(ids, bytes of each token) of a text by either library, without any of the operator's code."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    two = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        pieces = [two.id_to_piece(i) for i in b]
        return (a, [bytes(to_byte[c] for c in one.id_to_token(i)) for i in a]), (b, [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)])

    return tokens


def brute(texts, plain):
    rows, count = [], Counter()
    for text in texts:
        row = {"a": [], "b": [], "groups": [], "links": Counter()}
        rows.append(row)
        if not text:
            continue
        (a, xa), (b, xb) = plain(text)
        if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (xa, xb)]
        row["a"], row["b"] = a, b
        at, place = [0, 0], [{e: i for i, e in enumerate(s)} for s in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for side, ids in enumerate((a, b)):
                stop = place[side][end] + 1
                group.append(ids[at[side] : stop])
                at[side] = stop
            row["groups"].append(group)
            row["links"].update((x, y) for x in group[0] for y in group[1])
        count.update(row["links"].keys())
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (
            len(r["a"]), len(r["b"]), len(r["groups"]), sum(r["links"].values()), sum(n for k, n in r["links"].items() if count[k] == most[k[0]]), sum(n * count[k] for k, n in r["links"].items()),
            hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in r["groups"]).encode()).hexdigest() if r["groups"] else "",
        )
        for r in rows
    ]


def check(df, plain):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = al.align(df, A, B)
    assert out.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], plain), strict=True)]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))


def test_whole_table(spark, docs, plain):
    check(docs, plain)


def test_odd_rows(spark, odd, empty, plain):
    texts = ["▁ not a space", "<s></s><unk><|endoftext|> <0x41>", " lead", "  two\n\n\n", "\t\r\n", "\x00\x01", "\U0001f600" * 30, "ééé ñ 中文字", "a" * 500, "aaab" * 99, "=" * 77 + "-" * 1001, "12345678901234567890", " 　x", "é"]
    more = spark.createDataFrame([(100 + i, t, "en", "s", None, 1) for i, t in enumerate(texts)], odd.schema)
    check(odd.union(more).withColumnRenamed("kept", "n_best").repartition(3), plain)
    assert al.align(empty, A, B).collect() == []


def test_very_long_texts(spark, odd, plain):
    """A text of white space alone, on which the fast encoder gives up, and one of 2 MB."""
    rows = [(1, " " * 400_000, None, None, None, None), (2, "word " * 400_000, None, None, None, None)]
    check(spark.createDataFrame(rows, odd.schema), plain)


def test_small_chunks_blocks_and_slices(spark, docs, plain, monkeypatch):
    """Many chunks in many slices, blocks of a few pairs; the tasks fork after the change, so they see it."""
    for name, value in (("CHUNK_BYTES", 3000), ("SLICE", 4), ("BLOCK", 50)):
        monkeypatch.setattr(al, name, value)
    rows = [r.asDict()["text"] for r in docs.limit(60).collect()]
    runs = {}
    for d in range(0, 60, 3):
        for batch in al._chunk_rows(d, [d, d + 1, d + 2], rows[d : d + 3], (A, B)):
            for r in batch.to_pylist():
                if r["kind"]:
                    runs.setdefault(r["radix"], []).append(r)
    want = Counter()
    for t in rows:
        (a, xa), (b, xb) = plain(t)
        ends = [np.cumsum([len(x) for x in s]) for s in (xa, xb)]
        both = np.intersect1d(*ends)
        ga, gb = (np.searchsorted(both, e) for e in ends)
        want.update({(x, y) for g in range(len(both)) for x in np.array(a)[ga == g].tolist() for y in np.array(b)[gb == g].tolist()})
    got = {}
    for radix, own in runs.items():
        for p, c in al.merged(al._heads(r["pairs"] for r in own)):
            got |= {(((x >> 17) << al.RADIX_BITS) | radix, x & (1 << 17) - 1): n for x, n in zip(p.tolist(), c.tolist(), strict=True)}
    assert got == dict(want)


@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(1, 9)), max_size=5), st.integers(1, 4))
@settings(deadline=None)
def test_merge(runs, block):
    blocks = []
    for r in runs:
        p, c = np.array(sorted(r), np.int64), np.array([r[k] for k in sorted(r)], np.int64)
        blocks.append([[p[i : i + block], c[i : i + block]] for i in range(0, len(p), block)])
    got = [(int(p), int(c)) for x in al.merged(blocks) for p, c in zip(*x, strict=True)]
    total = Counter()
    for r in runs:
        total.update(r)
    assert got == sorted(total.items())


def test_large_groups_count_links_by_distinct_ids():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 250)
    ga, gb = np.repeat([0, 1, 2], [200, 1, 99]), np.repeat([0, 1, 2], [100, 3, 147])
    got = Counter()
    for g, x, y, m in al._links(a, b, ga, gb, 3):
        for k in zip(g.tolist(), x.tolist(), y.tolist(), m.tolist(), strict=True):
            got[k[:3]] += k[3]
    assert got == Counter((int(g), int(x), int(y)) for g in range(3) for x in a[ga == g] for y in b[gb == g])


@given(st.lists(st.lists(st.integers(0, 1 << 40), max_size=5), max_size=4))
def test_packing(columns):
    assert [c.tolist() for c in al.unpack(al.pack(*(np.array(c, np.int64) for c in columns)))] == columns
