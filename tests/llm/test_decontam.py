import hashlib
import re

import pytest

from fleetlake.llm.decontam import contamination, search


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                names = windows.get(tuple(w[k : k + s]))
                if names:
                    hit.update(range(k, k + s))
                    found |= names
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_hits_agree_with_brute_force(spark, request, table):
    df = request.getfixturevalue(table)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "one"), (903, "Apache LICENSE"), (904, "g h i j k l m n o p q r s"), (904, "one two"), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(df.select("doc_id", "text", "source"), bench).collect()
    items[-1:] = []
    want = list(brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], items))
    key = lambda x: str(x)
    plain = contamination(df.select("doc_id", "text"), bench.where("item_id is not null")).drop("text").collect()
    assert sorted(map(tuple, plain), key=key) == sorted(want, key=key)
    assert len(got) == len(want)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "delta")], "key long, text string")
    items = spark.createDataFrame([(7, "alpha delta")], "item_id long, text string")
    found = {(r.key, r.distance) for r in search(docs, items, slop=3).collect()}
    assert found == {(1, 2), (2, 3)}


def test_proximity_compares_every_word_in_order(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item.replace("five", "five x"), item.replace("two", "x two").replace("nine", "y nine"), item.replace("four", "x y z four"), item.replace("five six", "six five"), item.replace("seven", "seventy"), "one one " + item[4:], item + " ten", "x " + item.replace("ten", "y ten")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=2)
    got = {r.doc_id: (r.contaminated, r.n_near) for r in out.collect()}
    assert got == {0: (True, 0), 1: (False, 1), 2: (False, 1), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (True, 0), 7: (True, 0), 8: (False, 1)}


def test_no_items(spark, docs):
    out = contamination(docs.select("doc_id", "text"), spark.createDataFrame([], "item_id long, text string"))
    assert out.where("contaminated or n_hit > 0").isEmpty() and out.count() == docs.count()
