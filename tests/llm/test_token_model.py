"""The character model of op8: brute-force probabilities, growth with the text, trust."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlake.llm import kneser_ney
from fleetlake.llm.common import saved
from fleetlake.llm.kneser_ney import ORDER, gram_counts, gram_model, hashed_model, perplexities, perplexity_filter

TRAIN = ["the cat saw the dog", "the dog saw a cat.", "a cat, the cat", "the dog ran"] * 2


def brute(train, texts):
    """Perplexity of each text's characters by a plain recursion."""
    pad = lambda t: ["<s>"] * (ORDER - 1) + [*t, "</s>"]
    grams = lambda t: [tuple(pad(t)[i : i + ORDER]) for i in range(len(t) + 1)]
    tables = {ORDER: {}}
    for t in train:
        for g in grams(t):
            tables[ORDER][g] = tables[ORDER].get(g, 0) + 1
    for m in range(ORDER - 1, 0, -1):
        tables[m] = {}
        for g in tables[m + 1]:
            tables[m][g[1:]] = tables[m].get(g[1:], 0) + 1
    cuts = {}
    for m, t in tables.items():
        n = [sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else None
        cuts[m] = [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else k / 2)) for k in (1, 2, 3)]

    def p(g):
        m = len(g)
        t = tables[m]
        mine = {h: c for h, c in t.items() if h[:-1] == g[:-1]}
        low = p(g[1:]) if m > 1 else 1 / (len(t) + 1)
        if not mine:
            return low
        cut = lambda c: cuts[m][min(c, 3) - 1]
        total = sum(mine.values())
        return (max(0, t[g] - cut(t[g])) if g in t else 0) / total + sum(map(cut, mine.values())) / total * low

    if texts is None:
        return p
    out = []
    for text in texts:
        logs = [math.log(p(g)) for g in grams(text)]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


def brute_log(train, context, char):
    return math.log(brute(train, None)((*(["<s>"] * (ORDER - 1) + [*context])[1 - ORDER :], char)))


@pytest.mark.parametrize(("hot", "pack", "words"), [(0, 1, 1), (5, 40, 1 << 10), (0, 1 << 20, 1 << 21), (1 << 16, 1 << 20, 1)])
def test_perplexities_agree_with_brute_force(spark, hot, pack, words, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT", hot)
    monkeypatch.setattr(kneser_ney, "FILTER_WORDS", words)
    texts = [*dict.fromkeys(TRAIN), "a zebra saw the cat", "###", "cat dog cat dog", "中文 the cat \U0001f600é", "the cat " * 600]
    model, unknown = gram_model(gram_counts(spark.createDataFrame([("en", t) for t in TRAIN], "lang string, text string")))
    given = spark.createDataFrame([(bytes([i]), "en", t) for i, t in enumerate(texts)], "key binary, lang string, text string")
    got = perplexities(given, saved(hashed_model(model), "model"), unknown, pack).orderBy("key").collect()
    assert [r.perplexity for r in got] == pytest.approx(brute(TRAIN, texts), rel=1e-5)
    assert [r.n_symbols for r in got] == [len(t) + 1 for t in texts]


def test_counts_agree_with_brute_force(spark, monkeypatch):
    texts = [("en", "abcabc ab!"), ("en", "ABC"), ("de", "é1 中"), ("de", "é1 中")]
    want = Counter()
    for lang, t in texts:
        line = "\x02" * (ORDER - 1) + t + "\x03"
        want.update((lang, line[i : i + ORDER]) for i in range(len(t) + 1))
    for held in (3, 1000):
        monkeypatch.setattr(kneser_ney, "HELD", held)
        got = {(r.lang, r.gram): r.c for r in gram_counts(spark.createDataFrame(texts, "lang string, text string")).collect()}
        assert got == want


def test_probabilities_add_up():
    """After any context, the seen characters and one share for an unknown one come to 1."""
    train = ["the cat and the hat on the mat, then that "] * 3
    chars = sorted({*"".join(train)})
    for context in ("", "the c", "hat o", "zzzzz"):
        # p(char | context) as a ratio of text probabilities without their ends
        logs = {x: brute_log(train, context, x) for x in [*chars, "</s>", "unknown"]}
        assert sum(map(math.exp, logs.values())) == pytest.approx(1)


def test_model_grows_with_the_text(spark):
    size = lambda n: gram_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(n).select("lang", "text")).count()
    assert size(800) > 1.5 * size(200)


def test_toxic_text_is_not_trusted(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} " * 8, "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert all(r.perplexity is None and r.kept for r in perplexity_filter(docs, labels).collect())
