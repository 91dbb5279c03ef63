import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import langid


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 400).astype(np.uint8)) for _ in range(6)]
    p = langid.train(texts, [0, 1, 0, 1, 0, 1], 2)
    data = np.frombuffer(texts[0][: langid.WINDOW], np.uint8)
    logs, used, _ = langid.window_logs(data, np.array([0, len(data)]), langid.tables(p))
    prob, _, _ = langid._forward(langid.BYTE_CLASSES[data][None], p)
    assert np.allclose(np.exp(logs), prob, atol=1e-4) and used[0] == langid.WINDOW


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = langid.predict_languages(docs.where(held), docs.where(~held)).where("n_chars >= 200")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, docs, table):
    df = request.getfixturevalue(table)
    out = langid.predict_languages(df, docs).collect()
    assert len(out) == df.count()
    for r in out:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.predict_languages(df, docs.limit(0)).collect()} <= {"und"}


def test_sample_has_distinct_texts_of_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 30)
    rows = [("hot", "one hot text again and again")] * 3000 + [("few", f"zqz xqx jqj qzq {chr(97 + i)}") for i in range(3) for _ in range(1000)]
    rows += [("many", f"plain words with number {i} " + "and more words " * 40) for i in range(100)] + [(f"l{i:03}", f"a text of language {i}") for i in range(210)]
    given = spark.createDataFrame(rows, "lang string, text string")
    drawn = langid.training_sample(given).toPandas()
    assert drawn.groupby("lang").size().to_dict() == {"hot": 1, "few": 3, "many": 30} | {f"l{i:03}": 1 for i in range(210)}


def test_copies_do_not_hide_a_language(spark):
    few = [("few", f"zqz xqx jqj qzq zxz {x} " * 8) for x in ("jqq", "xzz", "qxj") for _ in range(1500)]
    other = [("other", f"the plain words of number {i} are here and there ") for i in range(400)]
    given = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(few + other)], "doc_id long, text string, lang string")
    out = langid.predict_languages(given, given).where("lang = 'few'")
    assert {r.lang_pred for r in out.select("lang_pred").distinct().collect()} == {"few"}


def test_windows_reach_the_end_of_a_long_text():
    assert langid._windows(b"a" * 100_000 + b"end")[-1].endswith(b"end")
