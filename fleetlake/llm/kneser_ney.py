"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts a character from the ORDER - 1 before it. Characters are real code points, case
and script kept, without any fixed vocabulary, so the tables grow with the corpus in every script.
A log-probability is a sum of table values, one for each n-gram and context of a text that the model
has seen. N-grams are counted and modelled as strings in Spark, sharded by (language, n-gram). For
scoring they go by 64-bit hashes. Tasks gather texts in packs of bounded size. Each distinct n-gram of a
pack meets the model in a join dealt by n-gram; values found go back to the pack, where the lists of its
texts' n-grams wait, and are summed up there: rows grow with packs' n-grams, not with tasks times texts. Only the few n-grams that nearly all texts hold are looked up beside the texts, as
hot keys; a filter of fixed size keeps most n-grams that the model lacks out of the join. Values are
whole numbers of 1 / UNIT, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import kept_apart, saved, small
from .textops import U64, let_go, mix, text_chunks

#: Characters of an n-gram.
ORDER = 5
#: N-grams that are looked up beside the texts, 12 bytes each; results do not depend on it.
HOT = 1 << 18
#: A pack is closed once it holds so many (n-gram, text) pairs; results do not depend on it.
PACK_PAIRS = 3_000_000
#: Bytes of text from which n-grams are taken at once; results do not depend on it.
PACK_BYTES = 1 << 19
#: 64-bit words of the filter that tells most n-grams that the model lacks; a fuller filter passes more rows to the join, no others.
FILTER_WORDS = 1 << 21
#: Steps of a table value, for one.
UNIT = 1 << 20
#: A language's threshold: this quantile of held-out trusted documents' perplexity, times MARGIN.
QUANTILE = 0.99
MARGIN = 1.5
#: Bytes below which a text says too little to be rejected.
MIN_BYTES = 100
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1_500_000
#: Stand before and after each text; a text's own U+0002 and U+0003 count as these.
START, END = 2, 3
_FACTORS = np.random.default_rng(41).integers(1 << 62, 1 << 63, ORDER, dtype=np.uint64) | U64(1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with ORDER starts before and an end after each text, places of the last start and all after it, their texts).

    U+0000 counts as U+FFFD.
    """
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    points = np.where(points == 0, np.uint32(0xFFFD), points)
    first = np.concatenate(([0], np.cumsum(lead)))[offsets]
    size = np.diff(first) + 2
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(text)) + (ORDER - 1) * (text + 1)
    line = np.full(len(text) + (ORDER - 1) * len(size), START, np.uint32)
    own = np.ones(len(text), bool)
    ends = np.cumsum(size) - 1
    own[ends] = own[ends - size + 1] = False
    line[at[own]] = points
    line[at[ends]] = END
    return line, at, text


def _codes(langs: list[str]) -> dict[str, np.uint64]:
    return {x: U64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}


def _hash(columns: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The hash of n-grams given as columns of code points, the last first."""
    h = codes + U64(len(columns) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor, c in zip(_FACTORS, columns, strict=False):
        h = h + c.astype(U64) * factor
    return mix(h)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct numbers, a place of each, where each of ``h`` stands among them)."""
    order = np.argsort(h)
    h = h[order]
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return h[first], order[first], back


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []  # hash, count, code points, language
    names: list[str] = []

    def merged() -> tuple[np.ndarray, ...]:
        h, c, points, lang = zip(*held, strict=True)
        held.clear()
        h, first, at = _distinct(np.concatenate(h))
        c = np.bincount(at, np.concatenate(c)).astype(np.int64)
        del at
        points = np.concatenate(points)
        return h, c, points[first], np.concatenate(lang)[first]

    def rows() -> pa.RecordBatch:
        _, c, points, lang = merged()
        grams = np.ascontiguousarray(points).view(f"<U{ORDER}").reshape(-1)
        return pa.record_batch([pa.array(names).take(pa.array(lang)), pa.array(grams), pa.array(c)], names=["lang", "gram", "c"])

    let_go()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names.extend(sorted(set(langs) - set(names)))
        number = np.array([names.index(x) for x in langs], np.int32)
        codes_of = _codes(names)
        codes = np.array([codes_of[x] for x in names], U64)
        for row, data, offsets in text_chunks(batch.column(1), PACK_BYTES):
            line, at, text = _lines(data, offsets)
            real = line[at] != START
            at, lang = at[real], number[row + text[real]]
            h = _hash([line[at - k] for k in range(ORDER)], codes[lang])
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((h, c, line[at[first][:, None] - np.arange(ORDER - 1, -1, -1)], lang[first]))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield rows()
                    held.clear()
    if held:
        yield rows()
    let_go()


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, c) of all n-grams of ORDER characters of ``texts`` (lang, text)."""
    return texts.select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def gram_model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, value, heat) of all n-grams and contexts seen, (lang, unknown)) from ``gram_counts``.

    A character's log-probability is ``unknown``, that of a character never seen, plus the values of
    the n-grams that end there and of the contexts that end before it. Discounts D1, D2 and D3+ are
    estimated for each language and order; one share of the lowest order's freed mass is for unknown
    characters. Counts below the top order are numbers of distinct characters before the n-gram.
    """
    tables = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = saved(tables[m + 1].groupBy("lang", F.substring("gram", 2, m).alias("gram")).agg(F.count("*").alias("c")), f"counts{m}")
    values, lower, unknown = [], None, None
    for m in range(1, ORDER + 1):
        t = tables[m]
        n = t.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = [F.least(F.lit(k - 0.05), F.greatest(F.lit(0.05), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2)))) for k in (1, 2, 3)]
        n = saved(n.select("lang", *(x.alias(f"d{k}") for k, x in enumerate(d, 1))), "discounts")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(n), "lang").select("lang", "gram", "c", cut.alias("cut"))
        if m == 1:
            all_of = saved(t.groupBy("lang").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c") / (F.count("*") + 1)).alias("low_p")), "unigrams")
            unknown = all_of.select("lang", F.log("low_p").alias("unknown"))
            p = t.join(F.broadcast(all_of), "lang").withColumn("p", (F.col("c") - F.col("cut")) / F.col("total") + F.col("low_p"))
            p = p.withColumn("value", F.log(F.col("p") / F.col("low_p")))
        else:
            t = t.withColumns({"ctx": F.substring("gram", 1, m - 1), "low": F.substring("gram", 2, m - 1)})
            ctx = saved(t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("weight")), f"contexts{m}")
            values.append(ctx.select("lang", F.col("ctx").alias("gram"), F.log("weight").alias("value"), F.col("total").alias("heat")))
            base = F.col("weight") * F.col("low_p")
            p = t.join(ctx, ["lang", "ctx"]).join(lower, ["lang", "low"])
            p = p.withColumn("p", (F.col("c") - F.col("cut")) / F.col("total") + base).withColumn("value", F.log(F.col("p") / base))
        p = p.select("lang", "gram", "p", "value", F.col("c").alias("heat"))
        p = saved(p, f"p{m}") if m < ORDER else p
        values.append(p.select("lang", "gram", "value", "heat"))
        lower = p.select("lang", F.col("gram").alias("low"), F.col("p").alias("low_p"))
    every = reduce(DataFrame.union, values)
    return every.groupBy("lang", "gram").agg(F.sum("value").alias("value"), F.max("heat").alias("heat")), unknown


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, grams = batch.column(0).to_pylist(), batch.column(1)
        if not langs:
            continue
        codes_of = _codes(langs)
        codes = np.array([codes_of[x] for x in langs], U64)
        size = pc.utf8_length(grams).to_numpy()
        points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32)
        last = np.cumsum(size) - 1
        h = np.zeros(len(size), U64)
        for m in range(1, ORDER + 1):
            at = np.flatnonzero(size == m)
            h[at] = _hash([points[last[at] - k] for k in range(m)], codes[at])
        yield pa.record_batch([pa.array(h.view(np.int64)), batch.column(2), batch.column(3)], names=["gram", "value", "heat"])


def hashed_model(model: DataFrame) -> DataFrame:
    """(gram, value, heat) with the 64-bit hashes that stand for (lang, n-gram) in scoring; values in steps of 1 / UNIT, heat in steps of an eighth of its power of two."""
    heat = F.floor(8 * F.log2(F.col("heat"))).cast("int")
    value = F.rint(UNIT * F.col("value")).cast("int")
    return model.select("lang", "gram", value.alias("value"), heat.alias("heat")).mapInArrow(_hashed, "gram long, value int, heat int")


#: A text of a pack: its key (keys of other sizes go beside, by the text's number), symbols and sum over hot n-grams.
_TEXT = np.dtype([("key", "V16"), ("n", "<i8"), ("log", "<i8")])
_ROWS = "pack long, at int, gram long, texts binary, lists binary"
_NAMES = ["pack", "at", "gram", "texts", "lists"]


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as zstd over their lowest bytes, then the next ones; the count goes first."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        yield data[at + 8 : at + 8 + n]
        at += 8 + n


def _bits(gram: Column) -> Column:
    """The four bits (fewer where they fall together) that stand for an n-gram in its word of the filter."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(gram, at).cast("int").bitwiseAND(63)) for at in (40, 46, 52, 58)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _filter_of(model: DataFrame) -> np.ndarray:
    """FILTER_WORDS words with the bits of all n-grams of ``model``."""
    words = model.groupBy(F.pmod("gram", F.lit(FILTER_WORDS)).cast("int").alias("word")).agg(F.bit_or(_bits(F.col("gram"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return out


def _may_be_known(gram: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(gram), U64)
    for at in (40, 46, 52, 58):
        bits |= U64(1) << ((gram >> U64(at)) & U64(63))
    return words[(gram % U64(len(words))).astype(np.int64)] & bits == bits


def _places(grams: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where in sorted ``grams`` each of ``some`` stands, looked up once for each run of equal ones."""
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1])[: len(some)])
    return np.repeat(np.searchsorted(grams, some[first]).astype(np.int32), np.diff(first, append=len(some)))


def _placed(grams: np.ndarray, n: int, held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of each of n texts; by text and place in sorted ``grams``, steps from place to place and how often); empties ``held``.

    Two tasks beside an executor's heap have to fit: runs of texts are sorted apart, and pairs are freed as soon as they are placed.
    """
    pairs = sum(len(x[0]) for x in held)
    sizes, step = np.zeros(n, np.int64), np.zeros(pairs, np.int32)
    times = np.zeros(pairs, np.result_type(np.uint8, *(x[2].dtype for x in held)))
    at, run = 0, []
    held.reverse()
    while held or run:
        if held and (not len(held[-1][0]) or not run or held[-1][1].min() <= max(x[1].max() for x in run)):
            x = held.pop()
            if len(x[0]):
                run.append((_places(grams, x[0]), x[1], x[2]))
            continue
        place, text, often = (np.concatenate(x) for x in zip(*run, strict=True))
        run.clear()
        order = np.argsort(text * np.int64(len(grams)) + place)
        place, text = place[order], text[order]
        to = at + len(place)
        step[at:to] = np.where(np.diff(text, prepend=-1) > 0, place, np.diff(place, prepend=np.int32(0)))
        times[at:to] = often[order]
        sizes += np.bincount(text, minlength=n)
        at = to
    return sizes, step, times


def _pack_rows(pack: int, texts: list[np.ndarray], held: list[tuple[np.ndarray, ...]], odd: dict[int, bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each distinct n-gram of a pack with its place there, and one with the texts and, for each text, the places of its n-grams and how often it holds them.

    ``odd`` has the keys, by the text's number, that do not fit a text's own place for one.
    """
    texts = np.concatenate(texts)
    grams = np.unique(np.concatenate([np.zeros(0, U64), *(np.unique(x[0]) for x in held)]))
    sizes, step, times = _placed(grams, len(texts), held)
    lists = _joined([_squeezed(sizes), _squeezed(step), _squeezed(times), *(i.to_bytes(8, "little") + key for i, key in (odd or {}).items())])
    del step, times
    one = pa.array([pack], pa.int64())
    yield pa.record_batch([one, pa.nulls(1, pa.int32()), pa.array(mix(np.array([pack], U64)).view(np.int64)), pa.array([texts.tobytes()], pa.binary()), pa.array([lists], pa.binary())], names=_NAMES)
    for i in range(0, len(grams), 1 << 16):
        some = grams[i : i + (1 << 16)]
        none = pa.nulls(len(some), pa.binary())
        yield pa.record_batch([pa.array(np.full(len(some), pack)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array(some.view(np.int64)), none, none], names=_NAMES)


def _packs(shared, unknown: dict[str, int], pack_pairs: int):
    """The rows of ``_pack_rows`` of all packs that a task closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, value, words = shared.value
        seen: set[bytes] = set()  # copies in this task are scored once; a text's score does not depend on it
        pack, number, pairs = TaskContext.get().partitionId() << 40, 0, 0  # number: texts of the pack
        own, held, odd = [], [], {}
        for batch in batches:
            fresh = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            if len(fresh) < batch.num_rows:
                batch = batch.take(pa.array(fresh))
            langs = batch.column(1).to_pylist()
            codes_of = _codes(langs)
            codes = np.array([codes_of[x] for x in langs], U64)
            start = np.array([unknown.get(x, 0) for x in langs])
            for row, data, offsets in text_chunks(batch.column(2), PACK_BYTES):
                texts = len(offsets) - 1
                if own and (number + texts > 1 << 16 or pairs > pack_pairs):
                    yield from _pack_rows(pack, own, held, odd)
                    pack, number, pairs, own, held, odd = pack + 1, 0, 0, [], [], {}
                line, at, text = _lines(data, offsets)
                top, here, back = _distinct(_hash([line[at - k] for k in range(ORDER)], codes[row + text]))
                # the longest n-gram that ends at a place gives all others that end there, so each distinct one is looked up once
                columns, code = [line[at[here] - k] for k in range(ORDER)], codes[row + text[here]]
                total = np.zeros(len(top), np.int64)
                for m in range(1, ORDER + 1):
                    gram = top if m == ORDER else _hash(columns[:m], code)
                    is_hot = np.zeros(len(gram), bool)
                    if len(known):
                        found = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                        is_hot = known[found] == gram
                        total[is_hot] += value[found[is_hot]]
                    if len(words):
                        asked = ~is_hot & _may_be_known(gram, words)
                        names, which = np.unique(gram[asked], return_inverse=True)
                        of = np.zeros(len(gram), np.int64)
                        of[asked] = which
                        cold = np.flatnonzero(asked[back])
                        both = of[back[cold]] * texts + text[cold]
                        both, times = np.unique(both.astype(np.int32) if len(names) * texts < 1 << 31 else both, return_counts=True)
                        held.append((names[both // texts], (number + both % texts).astype(np.int32), times.astype(np.min_scalar_type(times.max(initial=0)))))
                        pairs += len(both)
                n = np.bincount(text, minlength=texts) - 1
                log = np.zeros(texts, np.int64)
                np.add.at(log, text, total[back])
                rows = np.empty(texts, _TEXT)
                keys = batch.column(0).slice(row, texts).to_pylist()
                odd |= {number + i: key for i, key in enumerate(keys) if len(key) != 16}
                rows["key"] = np.frombuffer(b"".join(key if len(key) == 16 else bytes(16) for key in keys), "V16")
                rows["n"], rows["log"] = n, log + n * start[row : row + texts]
                own.append(rows)
                number += texts
        if own:
            yield from _pack_rows(pack, own, held, odd)
        let_go()

    return run


#: (N-gram, text) pairs of a pack that are summed up at once, one text at least; results do not depend on it.
SUM_PAIRS = 1 << 18
#: Values that a task holds before it passes them on.
VALUES = 1_000_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, texts, lists): packs' own rows as they are, and the places and values that were found, one row for each pack and VALUES of them."""
    held: list[tuple[np.ndarray, ...]] = []

    def rows() -> pa.RecordBatch:
        pack, at, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, pack))
        pack, at, value = pack[order], at[order], value[order]
        packs, start = np.unique(pack, return_index=True)
        ends = np.append(start[1:], len(pack))
        lists = [_joined([_squeezed(np.diff(at[i:j], prepend=0)), _squeezed(value[i:j].view(np.uint32))]) for i, j in zip(start, ends, strict=True)]
        return pa.record_batch([pa.array(packs), pa.nulls(len(packs), pa.binary()), pa.array(lists, pa.binary())], names=["pack", "texts", "lists"])

    for batch in batches:
        pack, at, texts, lists, value = batch.columns
        own = texts.is_valid()
        yield pa.record_batch([x.filter(own) for x in (pack, texts, lists)], names=["pack", "texts", "lists"])
        met = pc.invert(own)
        held.append(tuple(x.filter(met).to_numpy() for x in (pack, at, value)))
        if sum(len(x[0]) for x in held) > VALUES:
            yield rows()
            held.clear()
    if sum(len(x[0]) for x in held):
        yield rows()
    held.clear()
    let_go()


def _pack_sums(table: pa.Table) -> pa.Table:
    """(key, n, log) of the texts of one pack, from its lists and the values found for its n-grams."""
    texts, sizes, step, times, odd, found = np.zeros(0, _TEXT), None, None, None, [], []
    for own, lists in zip(table["texts"].to_pylist(), table["lists"].to_pylist(), strict=True):
        if own is None:
            place, value = map(_unsqueezed, _parts(lists))
            found.append((np.cumsum(place, dtype=np.int64), value.view(np.int32)))
        else:
            texts = np.frombuffer(own, _TEXT)
            sizes, step, times, *odd = _parts(lists)
            sizes, step, times = map(_unsqueezed, (sizes, step, times))
    # one more than the last place found: all places after it have no value
    values = np.zeros(2 + max((int(x[0][-1]) for x in found), default=0), np.int64)
    for place, value in found:
        values[place] = value
    del found
    sizes = sizes.astype(np.int64)
    ends, sums = np.cumsum(sizes), np.zeros(len(sizes), np.int64)
    i = 0
    while i < len(sizes):  # runs of texts, as a whole pack's numbers at eight bytes are too many for two tasks beside an executor's heap
        start = ends[i] - sizes[i]
        to = max(i + 1, int(np.searchsorted(ends, start + SUM_PAIRS, "right")))
        first, last, own = ends[i:to] - sizes[i:to] - start, ends[i:to] - start, slice(start, ends[to - 1])
        places = np.concatenate(([0], np.cumsum(step[own], dtype=np.int64)))
        at = np.minimum(places[1:] - np.repeat(places[first], sizes[i:to]), len(values) - 1)
        total = np.concatenate(([0], np.cumsum(values[at] * times[own])))
        sums[i:to] = total[last] - total[first]
        i = to
    keys = [bytes(x) for x in texts["key"]]
    for x in odd:
        keys[int.from_bytes(x[:8], "little")] = x[8:]
    return pa.table({"key": pa.array(keys, pa.binary()), "n": texts["n"].copy(), "log": texts["log"] + sums})


def perplexities(texts: DataFrame, model: DataFrame, unknown: DataFrame, pack_pairs: int = PACK_PAIRS) -> DataFrame:
    """(key, n_symbols, perplexity) of every distinct key of ``texts`` (key binary, lang, text) under a saved ``hashed_model``."""
    heats = sorted(((r["heat"], r["n"]) for r in model.groupBy("heat").agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundred rows
    least, held = None, 0
    for heat, n in heats:
        if held + n > HOT:
            break
        least, held = heat, held + n
    hot = model.where(F.lit(False) if least is None else F.col("heat") >= least).select("gram", "value").toArrow()
    known = hot["gram"].to_numpy().view(U64)
    order = np.argsort(known)
    known, value = known[order], hot["value"].to_numpy()[order]
    rest = held < sum(n for _, n in heats)
    cold = model if least is None else model.where(F.col("heat") < least)
    shared = texts.sparkSession.sparkContext.broadcast((known, value, _filter_of(cold) if rest else np.zeros(0, U64)))
    start = {r["lang"]: round(UNIT * r["unknown"]) for r in unknown.collect()}
    rows = texts.select("key", "lang", "text").mapInArrow(_packs(shared, start, pack_pairs), _ROWS)
    met = rows.join(cold.select("gram", "value").hint("merge"), "gram", "left").where("texts is not null or value is not null")
    found = met.select("pack", "at", "texts", "lists", "value").mapInArrow(_found, "pack long, texts binary, lists binary")
    sums = found.groupBy("pack").applyInArrow(_pack_sums, "key binary, n long, log long")
    sums = sums.groupBy("key").agg(F.max("n").alias("n"), F.max("log").alias("log"))
    return sums.select("key", F.col("n").alias("n_symbols"), F.exp(-F.col("log") / UNIT / F.col("n")).alias("perplexity"))


_SCORES = ("n_symbols", "perplexity", "threshold", "kept")


def perplexity_filter(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, more) with n_symbols, perplexity, threshold and kept after its own columns.

    Trusted are the documents with quality 1 and not toxic in ``labels``; of these, ids with crc32 mod
    5 = 0 are held out of the counts and give each language's threshold: the quantile of their
    perplexity (of those with at least MIN_BYTES bytes), times ``margin``. ``n_symbols`` counts
    characters and the end of the text. ``kept`` is false for a text of at least MIN_BYTES bytes whose
    perplexity exceeds the threshold; a tie is kept. Null and empty texts have no symbols; they, and
    languages without trusted text, have no perplexity and are kept; a null language is a language of
    its own. A document labelled twice counts once if any label trusts it. Repeated rows get equal
    results, an empty table gives no rows. Own columns of the four names are replaced. Texts are known
    by MD5 of language and text.
    """
    good = labels.where("quality = 1 and doc_id is not null")
    if "toxic" in labels.columns:
        good = good.where("coalesce(toxic, 0) = 0")
    trusted = saved(good.select("doc_id").distinct(), "trusted")
    own = [c for c in docs.columns if c not in _SCORES]
    lang = F.coalesce("lang", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\0", lang, "text")))
    names = kept_apart(own, ("_lang", "_key", "_bytes"))
    rows = docs.select(*(F.col(c).alias(names[c]) for c in own), lang.alias("_lang"), key.alias("_key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"))
    texts = rows.where("_bytes > 0").select("doc_id", F.col("_lang").alias("lang"), F.col("_key").alias("key"), F.col("_bytes").alias("bytes"), "text")
    out_of = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    good_texts = texts.join(small(trusted), "doc_id", "left_semi")
    model, unknown = gram_model(saved(gram_counts(good_texts.where(~out_of)), f"counts{ORDER}"))
    model, unknown = saved(hashed_model(model), "model"), saved(unknown, "unknown")
    modelled = texts.join(F.broadcast(unknown.select("lang")), "lang", "left_semi")
    scores = saved(perplexities(modelled, model, unknown), "scores")
    held = good_texts.where(out_of).where(F.col("bytes") >= MIN_BYTES).select("key", "lang").join(small(scores), "key")
    limits = saved(held.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("threshold")).withColumnRenamed("lang", "_lang"), "limits")
    out = rows.join(small(scores.withColumnRenamed("key", "_key")), "_key", "left").join(F.broadcast(limits), "_lang", "left")
    rejected = (F.col("perplexity") > F.col("threshold")) & (F.col("_bytes") >= MIN_BYTES)
    symbols = F.when(F.col("_bytes") > 0, F.length("text") + 1).otherwise(0).cast("long")
    return out.select(*(F.col(names[c]).alias(c) for c in own), symbols.alias("n_symbols"), "perplexity", "threshold", (~F.coalesce(rejected, F.lit(False))).alias("kept"))
