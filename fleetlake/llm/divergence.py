"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives a histogram of character classes and one of its language's most frequent words. A language's reference is
the mean histogram of its distinct texts that pass the base rules; a text is rejected if its
Jensen-Shannon distance from its language's reference is too large. Short texts, whose histograms
are noise, are left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

#: Character classes, as the insides of regular-expression brackets, in the order in which they are taken out of a text; all else is a class of its own.
CHAR_CLASSES = ("a-z", r"\x20\x09-\x0D", "A-Z", r".,;:'\x22!?()\-", "#*$%&|<>", "0-9", r"\x{C0}-\x{24F}", r"+=~^/\\@_{}\[\]`")
SPACES, SYMBOLS = 1, 4
#: A language's common words are its so many most frequent ones, in lower case; all other words are one class.
TOP_WORDS = 8
#: Distances (square roots of divergences in bits, 0 to 1) above which a text is rejected.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.36
#: Words below which the histograms are not judged.
MIN_WORDS = 50

GAP = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The runs without ASCII white space."""
    inside = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inside != "", F.split(inside, GAP)).otherwise(F.array().cast("array<string>"))


def with_char_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with long columns ``char0``... of CHAR_CLASSES and, last, of all other characters; each class is counted in what the ones before leave."""
    df = df.withColumn("_left", text).withColumn("_size", F.length("_left"))
    for i, inside in enumerate(CHAR_CLASSES):
        df = df.withColumn("_left", F.regexp_replace("_left", f"[{inside}]+", "")).withColumn("_now", F.length("_left"))
        df = df.withColumn(f"char{i}", (F.col("_size") - F.col("_now")).cast("long")).drop("_size").withColumnRenamed("_now", "_size")
    return df.withColumn(f"char{len(CHAR_CLASSES)}", F.col("_size").cast("long")).drop("_left", "_size")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with array ``words``, the five base counts and those of ``with_char_counts``; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = with_char_counts(docs, text).withColumn("words", words_of(text))
    n = F.size("words")
    # windows of three words, as 64-bit hashes
    df = df.withColumn("windows", F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    # only texts that hold a window twice need them sorted with their places, where equal ones become neighbours
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))))
    df = df.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    last = F.size("windows") - 1
    twice = lambda x, j: ((j > 0) & (F.get("windows", j - 1)["w"] == x["w"])) | ((j < last) & (F.get("windows", j + 1)["w"] == x["w"]))
    df = df.withColumn("places", F.sort_array(F.transform(F.filter("windows", twice), lambda x: x["i"])))
    # a window covers three words, or those up to the next window that is found twice
    covered = F.aggregate(F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1), p + 3) - p)), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    return df.select(
        *docs.columns,
        "words",
        *(f"char{i}" for i in range(len(CHAR_CLASSES) + 1)),
        n.cast("long").alias("n_words"),
        (F.length(text) - F.col(f"char{SPACES}")).cast("long").alias("word_chars"),
        F.col(f"char{SYMBOLS}").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def common_words(texts: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """(lang, common): each language's ``top`` most frequent words with a letter, in lower case, ties by the word, over all ``texts`` (lang, text)."""
    words = texts.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = words.where(F.col("word").rlike(r"\p{L}")).groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    best = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("common"))


def line_of(words: Column) -> Column:
    """All words in lower case, each between two spaces of its own."""
    return F.lower(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))


def _word_counts(line: Column, n_words: Column, common: Column, top: int) -> list[Column]:
    """How often each common word occurs, and how often any other word: by what ``line_of`` loses without it."""
    counts = []
    for i in range(top):
        word = F.concat(F.lit(" "), F.coalesce(F.get(common, i), F.lit("")), F.lit(" "))
        lost = F.octet_length(line) - F.octet_length(F.replace(line, word, F.lit("")))
        counts.append(F.when(F.get(common, i).isNull(), 0).otherwise(F.floor(lost / F.octet_length(word)).cast("int")))
    return [*counts, n_words - sum(counts[1:], counts[0])]


def _shares(counts: list[Column] | Column, total: Column) -> Column:
    counts = F.array(*counts) if isinstance(counts, list) else counts
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total), F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: the square root of the divergence in bits."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge(
    docs: DataFrame,
    max_char: float = MAX_CHAR_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance).

    Words are runs without ASCII white space. A text fails the base rules with fewer than 50 words, or
    if more than half of its words lie in three-word windows that it holds twice. A null language is a
    language of its own. Its common words are the TOP_WORDS most frequent of all its texts. References are means over distinct texts, so copies weigh once; a language
    of which no text passes has none, and its texts have no distances and are judged by the base rules alone. Null and empty
    texts have zero counts, no distances, and fail. Repeated rows give equal results, an empty table no
    rows. Other columns are not read, so clashing names do no harm.
    """
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("lang")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang)
    common = saved(common_words(docs.select("lang", "text")), "common")
    df = base_counts(docs.join(small(common), "lang", "left")).withColumn("line", line_of(F.col("words"))).drop("words")
    chars = [F.col(f"char{i}") for i in range(len(CHAR_CLASSES) + 1)]
    df = df.select(
        "doc_id", "lang", *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.xxhash64("text").alias("digest"),
        _shares(F.array(*chars), F.length("text")).alias("chars"),
        F.array(*_word_counts(F.col("line"), F.col("n_words"), F.col("common"), TOP_WORDS)).alias("word_counts"),
    )
    df = df.select("doc_id", "lang", *BASE, "base_failed", "digest", "chars", _shares(F.col("word_counts"), F.col("n_words")).alias("words"))
    df = saved(df, "features")
    sizes = (("chars", len(CHAR_CLASSES) + 1), ("words", TOP_WORDS + 1))
    texts = df.where((~F.col("base_failed")) & (F.col("n_words") >= min_words)).groupBy("lang", "digest").agg(F.any_value("chars").alias("chars"), F.any_value("words").alias("words"))
    means = texts.groupBy("lang").agg(*(F.array(*(F.avg(F.get(name, i)) for i in range(n))).alias(f"{name}_reference") for name, n in sizes))
    df = df.join(small(saved(means, "references")), "lang", "left")
    judged = F.when(F.col("n_words") >= min_words, F.lit(True))
    distances = [F.when(judged & F.col(f"{name}_reference").isNotNull(), jensen_shannon(F.col(name), F.col(f"{name}_reference"))).alias(out) for (name, _), out in zip(sizes, ("char_distance", "word_distance"), strict=True)]
    df = df.select("doc_id", *BASE, "base_failed", *distances)
    too_far = F.coalesce((F.col("char_distance") > max_char) | (F.col("word_distance") > max_word), F.lit(False))
    return df.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~too_far).alias("kept"), "char_distance", "word_distance")
