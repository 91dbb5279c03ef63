"""The training-data queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver found it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import judge

    return judge(_table(spark, sf_dir, "documents"))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import similar_components

    out = similar_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.withColumnRenamed("id", "doc_id")


#: The fixed rules of op4.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linkgraph import judge_pages

    return judge_pages(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_languages

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    given = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict_languages(given, docs.where(~held_out).select("text", "lang")).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("expressions")


def op7_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import perplexity_filter

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity_filter(docs, _table(spark, sf_dir, "labels")).drop("text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op11_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .alignment import align

    out = align(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import failures, interaction_audit

    flags = failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return interaction_audit(flags, ["A", "B", "C", "D", "E"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w"
)
SQL = {
    "op10_positional_index": f"""WITH d AS (SELECT doc_id, {_WORDS} FROM documents),
b AS (SELECT item_id, {_WORDS} FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i:i + 9] AS win FROM b, range(1, greatest(len(w) - 9, 1) + 1) t(i) WHERE len(w) > 0),
m AS (SELECT doc_id, i, s, item_id FROM (SELECT doc_id, i, s, w[i:i + s - 1] AS win FROM d, (SELECT DISTINCT size AS s FROM bw) z, range(1, len(w) - s + 2) t(i)) JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS digest FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
 FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, CAST(fails[1] AS INT) + 2 * CAST(fails[2] AS INT) + 4 * CAST(fails[3] AS INT) + 8 * CAST(fails[4] AS INT) + 16 * CAST(fails[5] AS INT) AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: chr(65 + CAST(i AS INT))), '') AS filter_order, step, o[step] AS f, 1 << o[step] AS own, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant,
 sum(n) FILTER (mask = own) AS unique_fails, sum(g) FILTER (mask & before = 0 AND mask & own > 0) AS good_lost, sum(x) FILTER (mask & before = 0 AND mask & own > 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
