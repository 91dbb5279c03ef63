import re

import pytest

from fleetlake.llm.licenses import BASE_PHRASES, evaluate, scan_licenses, to_postfix


def test_postfix_binds_with_over_and_over_or():
    assert to_postfix("a OR b AND c WITH d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert to_postfix(["(", "a", "OR", "b", ")", "AND", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in ("a b", "AND a", "( a", "a )", "a OR", ""):
        assert to_postfix(bad.split()) is None


def test_evaluate_lists_alternatives():
    assert evaluate("(MIT OR Apache-2.0) AND BSD-3-Clause")[1] == [["apache-2.0", "bsd-3-clause"], ["bsd-3-clause", "mit"]]
    assert evaluate("GPL-2.0 WITH Classpath-exception-2.0")[0] == ["gpl-2.0+classpath-exception-2.0"]
    assert evaluate("MIT is the licence")[0] == ["mit"]
    assert evaluate("OR") is None


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_base_places_agree_with_brute_force(request, table):
    df = request.getfixturevalue(table)
    want = []
    for r in df.select("doc_id", "text").collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want.append((r.doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = scan_licenses(df).collect()
    key = lambda x: str(x)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_tags_add_labels(odd):
    row = scan_licenses(odd).where("doc_id = 11").first()
    assert row.labels == "apache,apache-2.0,bsd-3-clause,cc-by,mit" and row.score == 1.0


def test_long_combined_statements_keep_their_licences(spark):
    tag = " AND ".join(f"(l{i}a OR l{i}b)" for i in range(12))
    want = sorted(f"l{i}{x}" for i in range(12) for x in "ab")
    assert evaluate(tag) == (want, None)
    assert evaluate(tag + " AND MIT WITH exc")[0] == sorted([*want, "mit+exc"])
    row = scan_licenses(spark.createDataFrame([(1, f"SPDX-License-Identifier: {tag}")], "doc_id long, text string")).first()
    assert row.labels == ",".join(want) and row.score == 1.0
    assert row.expressions[0].split().count("and") == 11 and row.expressions[0].split().count("or") == 12
    odd = evaluate(" WITH ".join(f"(x{i}a OR x{i}b)" for i in range(40)))
    assert odd[1] is None and len(odd[0]) < 1000 and any("x39b" in x for x in odd[0])


@pytest.mark.parametrize(
    "tag, labels",
    [
        ("MIT.", "mit"), ("MIT and then more text", "mit"), ("Apache-2.0 or later version", "apache-2.0"), ("foo", ""), ("LicenseRef-own-1", "licenseref-own-1"), ("GPL-2.0-or-later, see COPYING", "gpl-2.0-or-later"),
        ("MIT or Apache-2.0", "apache-2.0,mit"), ("(MIT OR own) */", "mit,own"), ("MIT OR Apache-2.0. Then AND more", "apache-2.0,mit"), ("BSD-3-Clause with thanks", "bsd-3-clause"), ("the usual", ""), ("", ""),
    ],
)
def test_tags_end_where_prose_begins(spark, tag, labels):
    row = scan_licenses(spark.createDataFrame([(1, f"// SPDX-License-Identifier: {tag}\n")], "doc_id long, text string")).first()
    assert (row.labels, row.score == 1.0) == (labels, bool(labels))


def test_very_long_text(spark):
    row = scan_licenses(spark.createDataFrame([(1, "word " * 3_000_000 + "MIT license")], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (3_000_002, 1, 3_000_000, "mit")
