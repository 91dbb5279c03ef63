from pyspark.sql import functions as F

from fleetlake.llm.kneser_ney import perplexity_filter


def test_noise_goes_and_trusted_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = perplexity_filter(docs, labels)
    assert out.count() == docs.count()
    rate = {r.quality: r.kept for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.5


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    rows = perplexity_filter(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows if not r.text)
    assert perplexity_filter(empty, labels).collect() == []
    assert all(r.kept for r in perplexity_filter(odd, labels.limit(0)).collect())
