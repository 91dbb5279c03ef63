"""Repeated byte windows by a depth-limited most-significant-digit radix grouping of suffixes.

Only the first ``threshold`` bytes of a suffix matter, so suffixes are grouped digit by digit and
dropped as soon as they stand alone; suffixes that still share a group at the threshold are exactly
the repeated windows. Three things keep this in proportion to the input:

* The first digit (``DIGIT`` bytes) is read only at suffixes that are minimal among the windows
  they lie in (a local minimum of the rolling digit hash). Equal windows choose equal suffixes, so
  no repeat is missed, and some 1.5 % of all suffixes take part in the shuffle.
* The second digit is the rest of the widest context, to both sides. Suffixes that share it have
  all their windows repeated and are settled; equal ones meet already in the map task.
* What is left (edges of repeated passages) is refined to single bytes: small groups by comparing
  their contexts, larger ones by two more rounds of digits (runs of windows, then single windows),
  which are counted by hash and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small, text_key
from .textops import BYTE_CODES, U64, mix, span_hashes, text_chunks

THRESHOLD = 200
DIGIT = 64
#: Members up to which a group of differing contexts is compared directly.
GROUP = 2048
#: Pairs of members that are compared at once, and members that a task gathers for that; results do not depend on them.
PAIRS, HELD = 4096, 4096
#: Windows in a run of the third digit.
RUN = 12
_CODES2 = np.random.default_rng(29).integers(1, 2**63, 256, dtype=np.uint64)


def _digit_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the DIGIT bytes at each position (DIGIT is a power of two), by doubling."""
    h, size = BYTE_CODES[data], 1
    while size < DIGIT:
        x = h[:-size] * U64(0x9E3779B97F4A7C15)
        x += h[size:]
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        h, size = x, size * 2
    return h


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _anchors(hashes: np.ndarray, n: int, threshold: int) -> np.ndarray:
    """Positions whose digit hash is minimal in some window of ``threshold`` bytes of a text of n bytes."""
    span = threshold - DIGIT + 1
    low = _sliding(hashes, span, np.minimum)
    edge = np.zeros(span - 1, U64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), span, np.maximum) == hashes)


_OPEN = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("ctx", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_OPEN_SQL = "kind byte, h long, ctx long, key long, pos int, lo int, hi int"


def _settle_locally(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Settle contexts that occur twice among these suffixes; one open row (kind 1) stands for them elsewhere."""
    h, ctx, key, pos, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ctx, h))
    h, ctx, key, pos, lo, hi = (x[order] for x in (h, ctx, key, pos, lo, hi))
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    twice = ~head | ~np.concatenate((head[1:], [True]))
    out = [np.concatenate((x[twice], x[head])) for x in (h, ctx, key, pos, lo, hi)]
    kind = np.concatenate((np.full(twice.sum(), 2, np.int8), np.where(twice[head], 1, 0).astype(np.int8)))
    return pa.record_batch([pa.array(kind), *(pa.array(x.view(np.int64) if x.dtype == U64 else x) for x in out[:3]), *(pa.array(x.astype(np.int32)) for x in out[3:])], schema=_OPEN)


def _open_rows(threshold: int):
    reach = threshold - DIGIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1)):
                if len(data) < threshold:
                    continue
                hashes = _digit_hashes(data)
                found = []
                for i in range(len(offsets) - 1):
                    a, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    if n >= threshold:
                        pos = _anchors(hashes[a : a + n - DIGIT + 1], n, threshold)
                        found.append((pos, np.full(len(pos), a), np.full(len(pos), n), np.full(len(pos), keys[row + i])))
                if not found:
                    continue
                pos, base, n, key = (np.concatenate(x) for x in zip(*found, strict=True))
                left, right = np.maximum(pos - reach, 0), np.minimum(pos + threshold, n)
                ctx = span_hashes(data, base + left, base + right) ^ mix((pos - left).astype(U64))
                parts.append((hashes[base + pos], ctx, key, pos, left, np.minimum(pos, n - threshold)))
                held += len(pos)
                if held > 300_000:
                    yield _settle_locally(parts)
                    parts, held = [], 0
        if parts:
            yield _settle_locally(parts)

    return run


def _settle(threshold: int):
    """Over rows sorted by (h, ctx): kind 2 = all windows lo..hi repeat; 3 = to be refined; 4 = refined only as a witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # a last row whose successor is not seen yet
        prev_h = prev_ctx = None  # of the row before the held one
        for batch in _then_none(batches):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                if not len(cols[0]):
                    continue
            elif held is None:
                return
            else:
                cols = held
            last = batch is None
            kind, h, ctx = cols[0], cols[1], cols[2]
            n = len(h) - (not last)
            if n:
                same_h = np.zeros(len(h) + 1, bool)
                same_c = np.zeros(len(h) + 1, bool)
                same_h[1:-1] = h[1:] == h[:-1]
                same_c[1:-1] = same_h[1:-1] & (ctx[1:] == ctx[:-1])
                if prev_h is not None:
                    same_h[0] = h[0] == prev_h
                    same_c[0] = same_h[0] and ctx[0] == prev_ctx
                before_h, after_h, before_c, after_c = same_h[:-1], same_h[1:], same_c[:-1], same_c[1:]
                twice = before_c | after_c | (kind == 1)
                # a context's first or last row stands for it if another context stands beside it in the group
                witness = twice & ((~before_c & before_h) | (~after_c & after_h))
                refine = ~twice & (before_h | after_h)
                settled = (before_c | after_c) & (kind == 0)
                for flag, value in ((settled, 2), (refine, 3), (witness, 4)):
                    at = np.flatnonzero(flag[:n])
                    if len(at):
                        yield pa.record_batch([pa.array(np.full(len(at), value, np.int8)), *(pa.array(c[at]) for c in cols[1:])], schema=_OPEN)
                prev_h, prev_ctx = h[n - 1], ctx[n - 1]
            held = [c[n:] for c in cols]

    return run


def _then_none(batches):
    yield from batches
    yield None


_CONTEXT_SQL = "h long, key long, pos int, witness boolean, before binary, after binary"


def _contexts(threshold: int):
    reach = threshold - DIGIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            ends = (np.asarray(at.offsets) - at.offsets[0].as_py()) // 2
            hs, pos = at.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).T
            pos, wit = pos >> 1, (pos & 1) > 0
            for row, data, offsets in text_chunks(batch.column(1)):
                text, out = data.tobytes(), [[] for _ in range(6)]
                for i in range(len(offsets) - 1):
                    a, e = int(offsets[i]), int(offsets[i + 1])
                    for j in range(ends[row + i], ends[row + i + 1]):
                        p = a + int(pos[j])
                        for o, v in zip(out, (hs[j], keys[row + i], pos[j], bool(wit[j]), text[max(a, p - reach) : p], text[p : min(e, p + threshold)]), strict=True):
                            o.append(v)
                if out[0]:
                    yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], names=["h", "key", "pos", "witness", "before", "after"])

    return run


def _words(values: list[bytes], width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of 64-bit words, the first byte the lowest, and their sizes."""
    size = np.array([len(v) for v in values])
    width = -(-width // 8) * 8
    joined = b"".join((v[::-1] if flip else v).ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, "<u8").reshape(len(values), -1), size


def _common(m: np.ndarray, size: np.ndarray, some: np.ndarray, others: np.ndarray | slice) -> np.ndarray:
    """Bytes that each of some rows shares from the left, within both lengths, with the rows that ``others`` has for it."""
    differs = m[some][:, None] ^ m[others]
    at = (differs != 0).argmax(2)
    word = np.take_along_axis(differs, at[:, :, None], 2)[:, :, 0]
    # bits below the lowest one that differs, in whole bytes
    first = np.where(word != 0, 8 * at + (np.bitwise_count((word & (~word + U64(1))) - U64(1)) >> 3), 8 * m.shape[1])
    return np.minimum(first, np.minimum(size[some][:, None], size[others]))


def _compare(threshold: int):
    """Over rows sorted by h, groups of at most GROUP: byte spans of the windows that another member shares."""
    reach = threshold - DIGIT
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def spans(groups: list[list[tuple]]) -> Iterator[tuple[int, int, int]]:
        """Of groups of equal size."""
        n, rows = len(groups[0]), [r for g in groups for r in g]
        before, nb = _words([r[4] for r in rows], reach, True)
        after, na = _words([r[5] for r in rows], threshold, False)
        own = np.array([i for i, r in enumerate(rows) if not r[3]], np.int64)
        for i in range(0, len(own), max(1, PAIRS // n)):
            some = own[i : i + max(1, PAIRS // n)]
            others = (some - some % n)[:, None] + np.arange(n) if len(groups) > 1 else slice(None)
            start, end = np.maximum(threshold - _common(after, na, some, others), 0), np.minimum(_common(before, nb, some, others), reach)
            fit = start <= end
            fit[np.arange(len(some)), some % n] = False
            who = np.nonzero(fit)[0]
            if not len(who):
                continue
            first, last = (np.bincount(who * (reach + 2) + x, minlength=len(some) * (reach + 2)) for x in (start[fit], end[fit] + 1))
            on = np.cumsum((first - last).reshape(len(some), -1), axis=1) > 0
            step = np.diff(on.astype(np.int8), axis=1, prepend=0)
            # each row's runs begin and end in turn, the last end within reach + 1
            at, d1 = np.nonzero(step == 1)
            d2 = np.nonzero(step == -1)[1] - 1
            for j, a, b in zip(some[at].tolist(), d1.tolist(), d2.tolist(), strict=True):
                yield rows[j][1], rows[j][2] - b, rows[j][2] - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        whole: dict[int, list[list[tuple]]] = {}  # groups by their size
        held = 0
        out: list[tuple[int, int, int]] = []

        def compare():
            for groups in whole.values():
                out.extend(spans(groups))
            whole.clear()

        def flush():
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    if len(rows) > 1:
                        whole.setdefault(len(rows), []).append(rows)
                        held += len(rows)
                    rows = []
                    if held > HELD:
                        compare()
                        held = 0
                rows.append(r)
            if len(out) > 50_000:
                yield flush()
        if len(rows) > 1:
            whole.setdefault(len(rows), []).append(rows)
        compare()
        if out:
            yield flush()

    return run


def _window_rows(threshold: int, size: int):
    """For each row (h, key, pos, witness, before, after, d1, d2): hashes of runs of ``size`` windows of d1..d2.

    ``whole`` names all bytes of the run's windows, ``core`` those that its windows share.
    """
    schema = pa.schema([("whole", pa.int64()), ("core", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("witness", pa.bool_()), ("d1", pa.int32()), ("d2", pa.int32()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pos, witness, top1, top2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 6, 7))
            before, after = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            hs = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(key), 5000):
                part = range(at, min(at + 5000, len(key)))
                data = np.frombuffer(b"".join(x for i in part for x in (before[i], after[i])), np.uint8)
                nb = np.array([len(before[i]) for i in part])
                na = np.array([len(after[i]) for i in part])
                base = np.concatenate(([0], np.cumsum(nb + na)))[:-1] + nb
                low = np.maximum(top1[at : at + len(part)], threshold - na)
                high = np.minimum(top2[at : at + len(part)], nb)
                lists = [np.arange(a - a % size, b + 1, size) for a, b in zip(low, high, strict=True)]
                who = np.repeat(np.arange(len(part)), [len(x) for x in lists])
                if not len(who):
                    continue
                start = np.concatenate(lists)
                stop = np.minimum(start + size - 1, threshold - DIGIT)
                full = (start >= low[who]) & (stop <= high[who])
                names = []
                for left, right in ((np.where(full, stop, 0), np.where(full, threshold - start, 0)), (start, threshold - stop)):
                    a, e = base[who] - left, base[who] + right
                    one, two = span_hashes(data, a, e), span_hashes(data, a, e, _CODES2)
                    names.append(mix(one ^ mix(two ^ mix(left.astype(U64) * U64(1009) + (e - a).astype(U64)))).view(np.int64))
                i = np.asarray(part)[who]
                yield pa.record_batch([pa.array(names[0], mask=~full), pa.array(names[1]), pa.array(key[i]), pa.array(pos[i]), pa.array(witness[i].astype(bool)), pa.array(np.maximum(start, low[who]).astype(np.int32)), pa.array(np.minimum(stop, high[who]).astype(np.int32)), pa.array(hs[i])], schema=schema)

    return run


_WINDOW_SQL = "whole long, core long, key long, pos int, witness boolean, d1 int, d2 int, h long"


def _refined(contexts: DataFrame, threshold: int) -> DataFrame:
    """(key, lo, hi): windows lo..hi of the text ``key`` that another text or place shares."""
    sizes = contexts.groupBy("h").agg(F.count("*").alias("m"))
    hot = saved(sizes.where(F.col("m") > GROUP).select("h"), "hot")
    direct = contexts.join(small(hot), "h", "left_anti").repartition("h").sortWithinPartitions("h")
    out = direct.mapInArrow(_compare(threshold), "key long, lo int, hi int")
    large = contexts.join(small(hot), "h", "left_semi")
    runs = large.select("*", F.lit(0).alias("d1"), F.lit(threshold).alias("d2")).mapInArrow(_window_rows(threshold, RUN), _WINDOW_SQL)
    runs = saved(runs, "runs")
    twice = lambda df, name: df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("c")).where("c > 1").select(name)
    span = [F.col("key"), (F.col("pos") - F.col("d2")).alias("lo"), (F.col("pos") - F.col("d1")).alias("hi")]
    whole = twice(runs, "whole")
    shared = saved(runs.join(whole, "whole", "left_semi").select(*runs.columns), "shared")
    out = out.union(shared.where("not witness").select(span))
    rest = saved(runs.join(whole, "whole", "left_anti").select(*runs.columns), "rest")
    # one bearer of each settled run stays as a witness for runs that share only some of its windows
    rest = rest.union(shared.dropDuplicates(["whole"]).withColumn("witness", F.lit(True)))
    cores = twice(runs, "core").join(rest.where("not witness").select("core").distinct(), "core", "left_semi")
    rest = rest.join(cores, "core", "left_semi").select("h", "key", "pos", "witness", "d1", "d2")
    again = large.drop("witness").join(rest, ["h", "key", "pos"]).select("h", "key", "pos", "witness", "before", "after", "d1", "d2")
    singles = saved(again.mapInArrow(_window_rows(threshold, 1), _WINDOW_SQL), "windows")
    return out.union(singles.join(twice(singles, "whole"), "whole", "left_semi").where("not witness").select(span))


def _merged(threshold: int):
    """Sorted, maximal byte runs of each text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                runs: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in spans):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1] + threshold)
                    else:
                        runs.append([s[0], s[1] + threshold])
                out.append([{"start": a, "end": b} for a, b in runs])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["key", "runs"])

    return run


def repeated_runs(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", key: str = "key") -> DataFrame:
    """(key, runs): the maximal byte runs covered by ``threshold``-byte strings that also start elsewhere.

    ``docs`` has a long ``key`` that names each text (rows with one key must have one text). Null
    and short texts have no windows. Texts without repeats have no row. The result is a saved table.
    """
    if threshold < 2 * DIGIT:
        raise ValueError(f"threshold must be at least {2 * DIGIT} bytes")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = saved(docs.mapInArrow(_open_rows(threshold), _OPEN_SQL), "suffixes")
    scan = rows.where("kind < 2").repartition("h").sortWithinPartitions("h", "ctx").mapInArrow(_settle(threshold), _OPEN_SQL)
    scan = saved(scan, "settled")
    wanted = scan.where("kind > 2").groupBy("key").agg(F.flatten(F.collect_list(F.array("h", F.col("pos") * 2 + (F.col("kind") == 4).cast("long")))).alias("at"))
    wanted = saved(wanted, "wanted")
    holders = docs.join(small(wanted.select("key")), "key", "left_semi")
    contexts = holders.join(small(wanted), "key").select("key", "text", "at").mapInArrow(_contexts(threshold), _CONTEXT_SQL)
    contexts = saved(contexts, "contexts")
    spans = rows.where("kind = 2").select("key", "lo", "hi").union(scan.where("kind = 2").select("key", "lo", "hi")).union(_refined(contexts, threshold))
    merged = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = saved(merged.mapInArrow(_merged(threshold), "key long, runs array<struct<start:int,end:int>>"), "runs")
    discard(rows, scan, wanted, contexts)
    return out


def _cut(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_batches(batches, text_col)

    return run


def _cut_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, kept, digest = [], [], [], []
        runs_of = batch.column(1).to_pylist()
        for row, data, offsets in text_chunks(batch.column(0).field(text_col)):
            text = data.tobytes()
            for i in range(len(offsets) - 1):
                at, end, parts = int(offsets[i]), int(offsets[i + 1]), []
                begin, removed = at, 0
                for r in runs_of[row + i] or ():
                    parts.append(text[at : begin + r["start"]])
                    at = begin + r["end"]
                    removed += r["end"] - r["start"]
                parts.append(text[at:end])
                rest = b"".join(parts)
                n_bytes.append(end - begin)
                n_removed.append(removed)
                kept.append(rest.decode("utf-8", "ignore"))
                digest.append(hashlib.sha256(rest).hexdigest())
        arrays = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(r or ()) for r in runs_of], pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())]
        own = batch.column(0)
        yield pa.record_batch([own, *arrays], names=["own", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_bytes, n_removed, n_spans, kept_text and kept_sha256 after its own columns.

    A byte goes if a ``threshold``-byte string of the input covers it that also starts anywhere else,
    in this text or another. A text is seen as UTF-8 bytes; null counts as empty and loses nothing.
    Repeated rows, ids and texts are judged like any other: each copy is "elsewhere" for the others.
    ``kept_text`` leaves out a character that the cut breaks; the digest is over the exact bytes.
    Own columns of those five names are replaced. The repeats join by broadcast while few texts have
    any, else by a shuffle on a hash of id and text.
    """
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")]
    keyed = docs.select(F.struct(*own).alias("own"), text_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    runs = repeated_runs(keyed, threshold)
    joined = keyed.select("own", "key").join(small(runs), "key", "left").select("own", "runs")
    kind = docs.select(F.struct(*own).alias("own")).schema["own"].dataType.simpleString()
    out = joined.mapInArrow(_cut(text_col), f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string")
    return out.select("own.*", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")
