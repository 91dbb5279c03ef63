"""Exact set-similarity components of documents by PartEnum signatures.

Two sets with Jaccard similarity of at least g differ in at most k = (1-g)/(1+g) * (|A|+|B|) features.
Sets are put in size bands. Within a band the feature domain is cut into n1 partitions, so that in
one of them two similar sets differ in at most k2 features; each partition is cut again into n2 parts,
and every subset of n2 - k2 parts gives a signature, the hash of its content. Similar sets agree on
the whole of one such subset. n1, k2 and n2 are chosen for each band by the features that a signature
can be expected to hold, within a bound on the number of signatures. Subsets without features say
nothing and give no signature: ``slack`` extra partitions make up for them, and a set in which more
partitions than that have one gives signatures for those too, so no similar pair is lost.

Sets that share a signature form families (a superset of the true components). A family is first cut
down by the distances of its members' histograms, which never exceed the sets' true distances, then
by the sets themselves, both in bounded blocks of sets of matching sizes. Only links that join two
parts of a block's own forest are kept, so no task emits all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small
from .graph import components
from .textops import IS_SPACE, LOWER, U64, mix, ngram_hashes, span_hashes, text_chunks, word_spans

#: Target number of sets, and of features, in a block of a family; and of sets in a block of histograms.
BLOCK_SETS = 384
BLOCK_FEATURES = 400_000
SKETCH_SETS = 2048
#: Signatures of a task that are looked at for repeats before they are shuffled.
BATCH = 400_000
#: Bytes of text of which sets are made at once; results do not depend on it.
SET_BYTES = 1 << 18


class Bands:
    """Size bands of ratio 1/similarity, and the number of partitions for pairs whose larger set lies in each."""

    def __init__(self, percent: int):
        self.percent = percent
        g = Fraction(percent, 100)
        self.rate = (1 - g) / (1 + g)
        self.plans: dict[int, tuple[int, int, int, int]] = {}
        self.subsets: dict[tuple[int, int], np.ndarray] = {}
        self.upper = [0]
        while self.upper[-1] < 1 << 40:
            self.upper.append((self.upper[-1] + 1) * 100 // percent)

    def band(self, n: int) -> int:
        return bisect_left(self.upper, n)

    def distance(self, band: int) -> int:
        """The most features in which two similar sets of this band or the one below can differ."""
        return int(self.rate * 2 * self.upper[band])

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """(n1, k2, n2, slack), n1 with its slack: the most features a signature, with at most some 1.65 (k + 1) signatures."""
        if band not in self.plans:
            k, size = self.distance(band), self.upper[band]
            choices = []
            for k2 in range(min(k, 4) + 1):
                n1 = ceil((k + 1) / (k2 + 1))
                slack = n1 // 12 + (n1 > 2)
                for n2 in range(k2 + 1, 8):
                    if (n1 + slack) * comb(n2, k2) <= max(16, 1.65 * (k + 1) + 4):
                        choices.append((size * (n2 - k2) / ((n1 + slack) * n2), -(n1 + slack) * comb(n2, k2), (n1 + slack, k2, n2, slack)))
            self.plans[band] = max(choices)[2]
        return self.plans[band]

    def buckets(self, n: int) -> int:
        """Buckets of a set's histogram: a power of two that grows with its band, at most twice that of the band below."""
        return 1 << min(13, max(6, (self.upper[self.band(n)] // 8).bit_length()))


def _subsets(n2: int, k2: int) -> np.ndarray:
    """Rows: which of n2 parts are in each subset of n2 - k2."""
    chosen = np.zeros((comb(n2, k2), n2), bool)
    for row, parts in enumerate(combinations(range(n2), n2 - k2)):
        chosen[row, parts] = True
    return chosen


def signatures(u: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """The signatures of a set (sorted 64-bit features) for pairs whose larger set lies in ``band``."""
    n1, k2, n2, slack = bands.plan(band)
    part = (((u >> U64(32)) * U64(n1 * n2)) >> U64(32)).astype(np.int64)
    content = np.zeros(n1 * n2, U64)
    head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content[part[head]] = np.add.reduceat(mix(u), head)
    filled = np.zeros(n1 * n2, bool)
    filled[part[head]] = True
    content, filled = content.reshape(n1, n2), filled.reshape(n1, n2)
    chosen = bands.subsets.setdefault((n2, k2), _subsets(n2, k2))
    sums = np.zeros((n1, len(chosen)), U64)
    says = np.zeros((n1, len(chosen)), bool)
    for i in range(n2):
        sums += content[:, i : i + 1] * chosen[:, i]
        says |= filled[:, i : i + 1] & chosen[:, i]
    code = U64(band << 40) + np.arange(n1, dtype=U64)[:, None] * U64(len(chosen)) + np.arange(len(chosen), dtype=U64)
    sigs = mix(sums ^ mix(code))
    if n1 - says.all(1).sum() > slack:
        return sigs.reshape(-1)
    return sigs[says]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    starts, ends, first = word_spans(data, offsets, IS_SPACE)
    words = span_hashes(LOWER[data], starts, ends)
    shingles, at = ngram_hashes(words, first, n)
    for i in range(len(offsets) - 1):
        yield i, np.unique(shingles[at[i] : at[i + 1]])


def _sketch(u: np.ndarray, buckets: int) -> np.ndarray:
    """Histogram of a set, counts up to 255; cut or folded counts are never further apart than the sets."""
    return np.minimum(np.bincount((u & U64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def _set_rows(n: int, percent: int):
    """(id, n_shingles, h1, h2, sketch) of every text; the two hashes name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            size, h1, h2, sketch = (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U64), np.zeros(batch.num_rows, U64), [None] * batch.num_rows)
            for row, data, offsets in text_chunks(batch.column(1), SET_BYTES):
                for i, u in _sets(data, offsets, n):
                    size[row + i], h1[row + i], h2[row + i] = len(u), *_names(u)
                    if len(u):
                        sketch[row + i] = _sketch(u, bands.buckets(len(u))).tobytes()
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sketch, pa.binary())], names=["id", "n_shingles", "h1", "h2", "sketch"])

    return run


def _names(u: np.ndarray) -> tuple[np.uint64, np.uint64]:
    with np.errstate(over="ignore"):
        one, two = mix(u + U64(len(u))).sum(), mix(u ^ U64(0x5851F42D4C957F2D)).sum()
    return one, two


def _signature_rows(n: int, percent: int):
    """(sig, h1, root): signatures of every set that can have a similar, different one, each set once a task.

    Of the sets of a batch that share a signature only the least goes on as (sig, h1); the others come
    as edges (root, h1), so a signature that very many sets share costs one row for each batch.
    """

    def flush(sigs: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        sig, h1 = np.concatenate(sigs), np.concatenate(owners).view(np.int64)
        order = np.lexsort((h1, sig))
        head = np.concatenate(([True], sig[order][1:] != sig[order][:-1]))
        root = np.empty_like(h1)
        root[order] = h1[order][head][np.cumsum(head) - 1]
        first = np.zeros(len(sig), bool)
        first[order[head]] = True
        edges = np.unique(np.stack((root[~first], h1[~first]), 1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        sig = np.concatenate((sig[first], mix(edges[:, 1].view(U64))))  # edges go where their set's hash sends them
        roots = pa.array(np.concatenate((np.zeros(first.sum(), np.int64), edges[:, 0])), mask=np.arange(len(sig)) < first.sum())
        return pa.record_batch([pa.array(sig.view(np.int64)), pa.array(np.concatenate((h1[first], edges[:, 1]))), roots], names=["sig", "h1", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        sigs, owners, held = [], [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), SET_BYTES):
                for _, u in _sets(data, offsets, n):
                    if not len(u):
                        continue
                    h1 = _names(u)[0]
                    if h1 in seen:
                        continue
                    seen.add(h1)
                    j = bands.band(len(u))
                    for band in (j, j + 1):
                        if bands.distance(band):
                            sigs.append(signatures(u, band, bands))
                            owners.append(np.full(len(sigs[-1]), h1, U64))
                            held += len(sigs[-1])
                if held > BATCH:
                    yield flush(sigs, owners)
                    sigs, owners, held = [], [], 0
        if held:
            yield flush(sigs, owners)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by sig: an edge from each later set of a signature to its first one, and the edges that came as such."""
    last_sig, least = None, 0
    for batch in batches:
        made = batch.filter(batch.column(2).is_valid())
        pairs = [np.stack((made.column(2).to_numpy(), made.column(1).to_numpy()), 1)]
        batch = batch.filter(batch.column(2).is_null())
        sig, h1 = (batch.column(i).to_numpy() for i in (0, 1))
        if len(sig):
            head = np.concatenate(([last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]))
            group = np.cumsum(head)
            roots = np.concatenate(([least], h1[head]))[group]
            last_sig, least = sig[-1], roots[-1]
            differ = roots != h1
            pairs.append(np.stack((roots[differ], h1[differ]), 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _features(n: int):
    """(rep, pairs, payload) for each text of a family: its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = [None] * batch.num_rows
            names = batch.column(3).to_numpy()
            for row, data, offsets in text_chunks(batch.column(0), SET_BYTES):
                for i, u in _sets(data, offsets, n):
                    if len(u) and _names(u)[0].view(np.int64) == names[row + i]:  # else another text under the same id
                        feats[row + i] = u.tobytes()
            out = pa.record_batch([batch.column(1), batch.column(2), pa.array(feats, pa.binary())], names=["rep", "s", "payload"])
            yield out.filter(out.column("payload").is_valid())

    return run


def _links(percent: int, exact: bool):
    """The links of one pair of blocks that join its own parts: of sets, or else of histograms that do not rule similarity out."""

    def fold(x: np.ndarray, buckets: int) -> np.ndarray:
        return x.astype(np.int32).reshape(-1, buckets).sum(0, dtype=np.int32)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bands = Bands(percent)
        order = np.lexsort((table.column("rep").to_numpy(), table.column("size").to_numpy()))
        rep, side, size = (table.column(c).to_numpy()[order] for c in ("rep", "side", "size"))
        payload = np.array(table.column("payload").to_pylist(), dtype=object)[order]
        feats = [np.frombuffer(x, U64) for x in payload] if exact else None
        sketch = [_sketch(f, bands.buckets(len(f))) for f in feats] if exact else [np.frombuffer(x, np.uint8) for x in payload]
        wide = np.array([len(x) for x in sketch])
        # for each width, the members of this width and, folded, those of the next: similar sets differ by one step at most
        at_width = {w: (np.flatnonzero((wide == w) | (wide == 2 * w)), np.stack([fold(x, w) for x, y in zip(sketch, wide, strict=True) if y in (w, 2 * w)])) for w in np.unique(wide)}
        part = np.arange(len(rep))
        last = np.searchsorted(size, size * 100 // percent, "right")
        one_block = key[1:3] == key[3:5]
        out = []
        for i in range(len(rep)):
            members, counts = at_width[wide[i]]
            lo, hi = np.searchsorted(members, i, "right"), np.searchsorted(members, last[i])
            later = members[lo:hi]
            free = part[later] != part[i]
            if not one_block:
                free &= side[later] != side[i]
            later = later[free]
            if not len(later):
                continue
            # |A and B| >= g |A or B| means distance * (100 + percent) <= (100 - percent) * (|A| + |B|)
            near = np.abs(counts[lo:hi][free] - fold(sketch[i], wide[i])).sum(1) * (100 + percent) <= (100 - percent) * (size[later] + size[i])
            for j in later[near]:
                if part[i] == part[j]:
                    continue
                if exact:
                    x, y = feats[i], feats[j]
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                    if 100 * common < percent * (len(x) + len(y) - common):
                        continue
                part[part == part[j]] = part[i]
                out.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


_BLOCK = ("family", "band", "x", "other", "y")


def _dealt(members: DataFrame, sets: int, features: int) -> DataFrame:
    """``members`` (rep, family, size, band, more) with ``pairs``: the pairs of blocks (and the side) that each takes part in.

    A family within the bounds is one block; else each band is cut into blocks, and a block meets the
    others of its band and those of the bands next to it. Families of one set are left out.
    """
    all_of = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    all_of = saved(all_of.select("family", ((F.col("n") <= sets) & (F.col("weight") <= features)).alias("whole")), "families")
    blocks = members.join(small(all_of.where("not whole").select("family")), "family", "left_semi").groupBy("family", "band")
    blocks = saved(blocks.agg(F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("size") / features)).cast("int").alias("blocks")), "blocks")
    near = blocks.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = saved(blocks.join(near, ["family", "band"], "left").join(below, ["family", "band"], "left"), "plan")
    band, own = F.col("band"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = lambda band, x, other, y, side: F.struct(F.col("family"), band.alias("band"), x.alias("x"), other.alias("other"), y.alias("y"), side.cast("int").alias("side"))
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    pairs = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: pair(band, F.least(k, F.col("own")), band, F.greatest(k, F.col("own")), F.col("own") > k)),
        F.transform(upto(F.coalesce("above", zero)), lambda k: pair(band, F.col("own"), band + 1, k, zero)),
        F.transform(upto(F.coalesce("below", zero)), lambda k: pair(band - 1, k, band, F.col("own"), F.lit(1))),
    )
    whole = F.array(pair(F.lit(-1), zero, F.lit(-1), zero, zero))
    met = members.join(small(all_of), "family").join(small(plan), ["family", "band"], "left").withColumn("own", own)
    return met.select(*members.columns, F.when(F.col("whole"), whole).otherwise(pairs).alias("pairs"))


def _families(edges: DataFrame, classes: DataFrame, key: str, percent: int) -> DataFrame:
    """Members of the components of ``edges``, with their size band."""
    edge = F.array(*(F.lit(x) for x in Bands(percent).upper))
    family = components(edges).select(F.col("node").alias(key), F.col("label").alias("family"))
    return classes.join(family, key).withColumn("band", F.size(F.filter(edge, lambda x: x < F.col("size"))))


def _joined(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) of the blocks of ``rows`` (rep, size, payload, pairs)."""
    rows = rows.select("rep", "size", "payload", F.explode("pairs").alias("p")).select("p.*", "rep", "size", "payload")
    return rows.groupBy(*_BLOCK).applyInArrow(_links(percent, exact), "a long, b long")


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    A text's set is its distinct n-word shingles (A-Z lower-cased, words split at ASCII white space);
    with fewer words the whole sequence is one shingle, with none the set is empty. Two texts link when
    100 * |A and B| >= percent * |A or B| and neither is empty; equal sets therefore link. The component
    is the smallest id that links reach. A null or empty text is linked with nothing: its component is
    its own id. Ids are integers; rows with a null id link like others, but count for nothing in the
    minimum, and their component is null if no row that they reach has an id; repeated rows are equal
    sets. A text of any length is one set.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows without an id go by a hash of their text; statistics let the scan skip them where there are none
    named, others = docs.where("id is not null"), docs.where("id is null").withColumn("id", F.xxhash64(F.lit("no id"), "text"))
    docs = named.union(others)
    made = lambda df, own: df.mapInArrow(_set_rows(n, percent), "id long, n_shingles long, h1 long, h2 long, sketch binary").withColumn("own", own)
    sets = saved(made(named, F.col("id")).union(made(others, F.lit(None).cast("long"))), "sets")
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("own").alias("own"), F.max("n_shingles").alias("size"), F.any_value("sketch").alias("sketch"))
    classes = saved(classes, "classes")

    sigs = docs.select("text").mapInArrow(_signature_rows(n, percent), "sig long, h1 long, root long")
    edges = sigs.repartition("sig").sortWithinPartitions("sig", "h1").mapInArrow(_shared, "a long, b long")
    # a set's first ones over all its signatures join it and each other through the least of them:
    # one edge for each set, and few between first ones, instead of one for each shared signature
    firsts = edges.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("firsts"))
    spokes = firsts.select(F.get("firsts", 0).alias("a"), F.explode(F.concat(F.array("b"), F.slice("firsts", 2, F.size("firsts")))).alias("b"))
    wide = _families(saved(spokes.distinct(), "shared"), classes, "h1", percent)
    wide = saved(_dealt(saved(wide.select("rep", "family", "size", "band", "sketch"), "wide"), SKETCH_SETS, 1 << 40), "dealt")
    close = saved(_joined(wide.withColumnRenamed("sketch", "payload"), percent, False), "close")
    discard(wide)

    tight = _families(close, classes.select("rep", "h1", "size"), "rep", percent)
    tight = saved(_dealt(saved(tight, "tight"), BLOCK_SETS, BLOCK_FEATURES), "dealt")
    kind = tight.schema["pairs"].dataType.simpleString()
    found = docs.join(small(tight.select("rep", "h1", "size", "pairs")), docs["id"] == tight["rep"]).select("text", "rep", F.struct("size", "pairs").alias("s"), "h1")
    rows = found.mapInArrow(_features(n), f"rep long, s struct<size:bigint,pairs:{kind}>, payload binary").select("rep", "s.size", "s.pairs", "payload")
    joined = components(saved(_joined(rows, percent, True), "links"))
    discard(tight)

    joined = joined.withColumnRenamed("node", "rep").join(classes.select("rep", "own"), "rep")
    joined = joined.join(joined.groupBy("label").agg(F.min("own").alias("least")), "label").select("rep", "least", F.lit(True).alias("linked"))
    ids = classes.select("h1", "h2", "rep", "own").join(joined, "rep", "left")
    ids = saved(ids.select("h1", "h2", F.when(F.col("linked"), F.col("least")).otherwise(F.col("own")).alias("component")), "ids")
    return sets.join(ids, ["h1", "h2"], "left").select(F.col("own").alias("id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("own")).alias("component_id"))
