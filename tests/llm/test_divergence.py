import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm.divergence import MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, TOP_WORDS, jensen_shannon, judge

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORDS.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    hit = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_base_counts_agree_with_brute_force(request, table):
    df = request.getfixturevalue(table)
    got = judge(df).collect()
    want = [(r.doc_id, *(c := counts(r.text)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in df.select("doc_id", "text").collect()]
    key = lambda x: str(x)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_distance_of_distributions(spark):
    row = spark.range(1).select(
        jensen_shannon(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        jensen_shannon(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart"),
    ).first()
    assert row.same == 0 and row.apart == 1


def test_plain_prose_is_kept_and_symbol_noise_goes(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghilmnoprstu", k=6))
    prose = [(i, " ".join(f"the {word()} of {word()} and {word()} in {word()}" for _ in range(20)), "en") for i in range(1, 40)]
    noise = [(100, " ".join(f"q{k}###" + "$" * (k % 5) + "%%%&&&" for k in range(90)), "en")]
    rows = {r.doc_id: r.kept for r in judge(spark.createDataFrame(prose + noise, "doc_id long, text string, lang string")).collect()}
    assert not rows.pop(100) and all(rows.values())


CLASSES = ("[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", r"[.,;:'\x22!?()\-]", "[#*$%&|<>]", "[0-9]", "[À-ɏ]", r"[+=~^/\\@_{}\[\]`]")


def brute_verdicts(rows):
    """(kept, char_distance, word_distance) of each (text, lang): histograms, means over distinct texts and distances in numpy."""
    words = [WORDS.findall(t or "") for t, _ in rows]
    seen = {}
    for w, (_, lang) in zip(words, rows, strict=True):
        seen.setdefault(lang or "", Counter()).update(x.lower() for x in w if any(c.isalpha() for c in x))
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:TOP_WORDS]] for lang, c in seen.items()}
    chars, hist, passed = [], [], []
    for w, (t, lang) in zip(words, rows, strict=True):
        n = [len(re.findall(c, t or "")) for c in CLASSES]
        chars.append(np.array([*n, len(t or "") - sum(n)]) / max(len(t or ""), 1))
        low = Counter(x.lower() for x in w)
        n = [low[common[lang or ""][i]] if i < len(common[lang or ""]) else 0 for i in range(TOP_WORDS)]
        hist.append(np.array([*n, len(w) - sum(n)]) / max(len(w), 1))
        c = counts(t)
        passed.append(c[0] >= 50 and 100 * c[4] <= 50 * c[0])

    def distance(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return max(0.0, (part(p) + part(q)) / 2) ** 0.5

    first = {}
    for i, (t, lang) in enumerate(rows):
        if passed[i]:
            first.setdefault((lang or "", t), i)
    out = []
    for i, (_, lang) in enumerate(rows):
        of = [j for (other, _), j in first.items() if other == (lang or "")]
        if len(words[i]) < 50 or not of:
            out.append((passed[i], None, None))
            continue
        d = [distance(x[i], np.mean([x[j] for j in of], 0)) for x in (chars, hist)]
        out.append((passed[i] and d[0] <= MAX_CHAR_DISTANCE and d[1] <= MAX_WORD_DISTANCE, *d))
    return out


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_verdicts_agree_with_brute_force(request, table):
    df = request.getfixturevalue(table).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = df.collect()
    got = {r.doc_id: r for r in judge(df).collect()}
    for r, (kept, char, word) in zip(rows, brute_verdicts([(r.text, r.lang) for r in rows]), strict=True):
        assert got[r.doc_id].kept == kept
        assert got[r.doc_id].char_distance == (char and pytest.approx(char, abs=1e-9))
        assert got[r.doc_id].word_distance == (word and pytest.approx(word, abs=1e-9))
