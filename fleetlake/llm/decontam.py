"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Terms of the test set are counted over all training texts. Each test window is looked up by its
rarest terms: the index stores the postings (term, text, position) of those terms alone, their
lists are shifted by the term's place in the window and intersected, rarest first, and what is left
is compared word by word. Common terms are never posted, and no list is grouped by term, so a
frequent term or passage costs in proportion to its own occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_apart, saved, small, text_key

WINDOW = 10
#: Lists that are intersected before the words are compared.
LISTS = 2
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased runs of digits, small letters and characters beyond ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAP), lambda w: w != "")


def test_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, win, size, terms): the windows of every item; a shorter item, but not an empty one, is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    out = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))
    return out.distinct().select("item_id", F.xxhash64("terms").alias("win"), F.size("terms").alias("size"), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, pos) of ``terms`` (term) in ``docs`` (key, text), positions from 0; a saved table."""
    tokens = docs.select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return saved(tokens.join(small(terms), "term").select("term", "key", "pos"), "postings")


def _closest(here: Column, terms: Column, length: int) -> Column:
    """(span, at) of the shortest run of ``here`` that begins at one of its words and holds all ``terms`` in order; null if there is none."""
    # from each place of the first term, every next term is taken where it stands first
    after = lambda p, t: F.array_position(F.slice(here, p + 1, length), t).cast("int")
    end = lambda i: F.aggregate(F.slice(terms, 2, length), i + 1, lambda p, t: F.when((p < 0) | (after(p, t) == 0), -1).otherwise(p + after(p, t)))
    runs = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(F.get(here, i) == F.get(terms, 0), F.struct((end(i) - i).alias("span"), i.alias("at"))))
    return F.array_min(F.filter(runs, lambda r: r["span"] > 0))


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(key, item_id, start, size, distance): the places of ``docs`` (key, text) where a window of an item stands.

    distance 0 is an exact phrase. With ``slop`` > 0 there are also proximity matches: all words of the
    window stand in its order, with ``distance`` other words, ``slop`` at most, between them; of those
    around one pair of the rarest terms the closest is given.
    """
    windows = saved(test_windows(items, window), "windows")
    unique = windows.select("win", "size", "terms").distinct()
    at = unique.select("win", "size", F.posexplode("terms").alias("off", "term"))
    terms = saved(at.select("term").distinct(), "terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = saved(tokens.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("tf")), "frequencies")
    # a window with a term that no text holds can't occur
    ranked = at.join(counts, "term", "left").withColumn("r", F.row_number().over(W.partitionBy("win").orderBy(F.coalesce("tf", F.lit(0)), "term", "off")))
    absent = at.join(counts, "term", "left_anti").select("win").distinct()
    first = F.max(F.when(F.col("r") == 1, F.struct("term", "off"))).alias("one")
    second = F.max(F.when(F.col("r") == F.least(F.lit(LISTS), F.col("size")), F.struct("term", "off"))).alias("two")
    looked = saved(ranked.join(absent, "win", "left_anti").groupBy("win", "size").agg(first, second), "looked_up")
    wanted = saved(looked.select("one.term").union(looked.select("two.term")).distinct(), "wanted")
    postings = build_index(docs, wanted)

    def shifted(which: str) -> DataFrame:
        lists = looked.select("win", F.col(f"{which}.term").alias("term"), F.col(f"{which}.off").alias("off"))
        return postings.join(small(saved(lists, which)), "term").select("key", "win", (F.col("pos") - F.col("off")).alias("start"))

    # the two lists meet in cells of positions, as their places may differ by the slop
    cell = lambda c: F.floor(c / max(1, 4 * slop))
    at = F.col("start")
    one = shifted("one").withColumn("cell", F.explode(F.array_distinct(F.array(cell(at - slop), cell(at + slop)))))
    two = shifted("two").select("key", "win", at.alias("there"), cell(at).alias("cell"))
    met = one.join(two, ["key", "win", "cell"]).where(F.abs(F.col("there") - at) <= slop)
    met = met.select("key", "win", F.least("start", "there").alias("start")).where(at >= -slop).distinct()
    found = met.groupBy("key").agg(F.collect_list(F.struct("win", "start")).alias("at"))
    found = docs.join(small(saved(found, "candidates")), "key").select("key", words(F.col("text")).alias("w"), "at")
    begin = lambda x: F.greatest(F.lit(0), x["start"] - slop)
    here = lambda x: F.struct(x["win"].alias("win"), x["start"].alias("start"), begin(x).alias("begin"), F.slice("w", begin(x) + 1, window + 2 * slop).alias("here"))
    found = found.select("key", F.explode(F.transform("at", here)).alias("x")).select("key", "x.*").join(small(saved(unique, "unique")), "win")
    same = (F.col("start") >= 0) & (F.slice("here", F.greatest(F.lit(0), F.col("start") - F.col("begin")) + 1, F.col("size")) == F.col("terms"))
    if not slop:
        exact = found.where(same).select("key", "win", "start", F.lit(0).alias("distance")).distinct()
    else:
        found = found.withColumn("best", _closest(F.col("here"), F.col("terms"), window + 2 * slop))
        near = (F.col("best.span") > F.col("size")) & (F.col("best.span") <= F.col("size") + slop) & ~same
        exact = found.where(same).select("key", "win", "start", F.lit(0).alias("distance"))
        exact = exact.union(found.where(near).select("key", "win", F.col("begin") + F.col("best.at"), F.col("best.span") - F.col("size"))).distinct()
    return exact.join(small(windows.select("item_id", "win", "size")), "win").select("key", "item_id", "start", "size", "distance")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated after its own columns.

    With ``slop`` > 0 there is n_near too: the number of items of which a window stands in the text with
    1 to ``slop`` other words between its own; these count for no other column.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item
    (a shorter item is one window). n_items counts the items with an occurrence; items_sha256 is over
    their ids, sorted as strings and joined by commas (of the empty string if there are none). Null and
    empty texts and items have no words and no windows. Repeated rows, ids and items are judged alike;
    an empty item table hits nothing. Own columns of the five names are replaced.
    """
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["n_near"] if slop else []))
    own = [c for c in docs.columns if c not in made]
    apart = kept_apart(own, ("__key", "__items"))
    keyed = docs.select(*(F.col(c).alias(apart[c]) for c in own), text_key(docs, id_col, text_col).alias("__key"))
    places = saved(search(keyed.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), items, window, slop), "places")
    near = places.where("distance > 0").groupBy("key").agg(F.countDistinct("item_id").alias("n_near"))
    places = places.where("distance = 0")
    covered = places.select("key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    names = places.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("__items"))
    hits = covered.join(names, "key")
    hits = saved((hits.join(near, "key", "full") if slop else hits).withColumnRenamed("key", "__key"), "hits")
    out = keyed.withColumn("n_words", F.size(words(F.col(text_col))).cast("long")).join(small(hits), "__key", "left")
    return out.select(
        *(F.col(apart[c]).alias(c) for c in own),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("__items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).alias("n_near")] if slop else []),
    )
