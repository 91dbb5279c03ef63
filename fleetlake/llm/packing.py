"""Packing along a Hilbert curve: neighbouring documents share training sequences.

Every text is tokenised once into a saved table. Its tokens, hashed into a few dimensions with
random signs, give a vector; centred and scaled by the corpus's own mean and spread, it falls into
a cell of a grid whose cells a Hilbert curve visits one after the other. The cells' order, found by
a range sort of narrow rows, lays all documents end to end, and that line is cut every ``length``
tokens, so no sequence but the last has padding. Where a document stands on the line follows from
the per-partition totals of the sorted rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .textops import KEPT, U64, let_go, mix

LENGTH = 1024
SEPARATOR = 0
DIMS = 4
LEVELS = 8  # bits a dimension

_ENCODERS: dict[str, tuple] = {}
KEPT.append(_ENCODERS.clear)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable_bytes() -> dict[str, int]:
    """The byte-level alphabet of such vocabularies: printable bytes stand for themselves, others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def guarded(fast: Callable, slow: Callable) -> Callable:
    """``fast``, but ``slow`` for texts on which the rank-based encoder gives up (white space of some hundred thousand characters)."""

    def encode(text: str):
        try:
            return fast(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


def encoder(path: str):
    """An encoder of the byte-level BPE vocabulary at ``path``, with its special tokens.

    The vocabulary's ids are its merge ranks, so a rank-based encoder gives the same ids several times
    faster; where the file is of another kind, or a probe text differs, the file's own library is used.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        slow = lambda text: own.encode(text, add_special_tokens=False).ids
        encode = slow
        try:
            import tiktoken

            special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
            to_byte = _printable_bytes()
            ranks = {bytes(map(to_byte.__getitem__, word)): i for word, i in spec["model"]["vocab"].items() if word not in special}
            fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            probe = "The naïve  fox's\n\n\t12345 中文 \U0001f600 don't... ÀÉ|###!! " + " ".join(special)
            if fast.encode(probe, allowed_special="all") == slow(probe):

                encode = guarded(lambda text: fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text), slow)

        except (ImportError, KeyError, ValueError):
            pass
        _ENCODERS[path] = (encode, own.get_vocab_size())
    return _ENCODERS[path][0]


_signs: dict[int, np.ndarray] = {}


def _projected(ids: np.ndarray) -> np.ndarray:
    """A length-free projection of the hashed token counts: each token adds a random sign in every dimension."""
    n = 1 << 16
    if not len(_signs):
        bits = mix(np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15))
        _signs[0] = np.stack([((bits >> U64(7 * d + 3)) & U64(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], 1)
    if not len(ids):
        return np.zeros(DIMS)
    seen, counts = np.unique(ids & (n - 1), return_counts=True)
    weight = np.sqrt(counts).astype(np.float32)
    return weight @ _signs[0][seen] / np.sqrt((weight**2).sum())


def _tokenised(path: str):
    fields = [("id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), *((f"v{d}", pa.float64()) for d in range(DIMS))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            own, rows, held = batch.column(0), [], 0
            at = 0
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], np.uint32)
                packed = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
                rows.append((bytes([packed.itemsize]) + packed.tobytes(), len(ids), *_projected(ids[:-1]).tolist()))
                held += len(ids)
                if held > 2_000_000:
                    yield pa.record_batch([own.slice(at, len(rows)), *(pa.array(x, f[1]) for x, f in zip(zip(*rows, strict=True), fields[1:], strict=True))], schema=schema)
                    at, rows, held = i + 1, [], 0
            if rows:
                yield pa.record_batch([own.slice(at, len(rows)), *(pa.array(x, f[1]) for x, f in zip(zip(*rows, strict=True), fields[1:], strict=True))], schema=schema)
        del encode
        let_go()

    return run


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``cells`` (n, dims), each cell number below 2**bits.

    The transpose form: from the top bit down, undo the turns of each orthant, then Gray-decode over
    the dimensions and interleave.
    """
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ t) >> b & 1)
    return key


def _keyed(mean: list[float], spread: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(3 + d).to_numpy() for d in range(DIMS)], 1) if batch.num_rows else np.zeros((0, DIMS))
            z = (v - mean) / spread
            # the logistic curve is close to the normal distribution's: cells get about equal shares
            cells = np.minimum((1 << LEVELS) - 1, (1 << LEVELS) / (1 + np.exp(-1.702 * z))).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(hilbert_key(cells, LEVELS))], names=["uid", "tie", "n", "curve"])

    return run


def _offsets(totals: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = totals.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            n = batch.column(1).to_numpy()
            end = at + np.cumsum(n)
            at = int(end[-1]) if len(end) else at
            yield pa.record_batch([batch.column(0), pa.array(end - n)], names=["uid", "at"])

    return run


_PIECES_SQL = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pieces(length: int):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for own, packed, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(), strict=True):
                packed = packed.as_py()
                ids = np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype("<u4")
                start, at = 0, int(at)
                while start < len(ids):
                    take = min(len(ids) - start, length - at % length)
                    rows.append((own, start, take, ids[start : start + take].tobytes(), len(ids), at // length, at % length))
                    start, at, held = start + take, at + take, held + take
                if held > 1_000_000:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all rows, packed into sequences of ``length`` tokens.

    A document is its tokens and then token 0; ``ids`` are little-endian unsigned 32-bit numbers. Every
    token of every row lies in exactly one piece; all sequences but the last are full. Equal texts
    stand side by side; ties are ordered by id. Null and empty texts are a lone token 0; repeated rows
    and ids, null ids too, are packed row by row; an empty table gives no pieces.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    vectors = ", ".join(f"v{d} double" for d in range(DIMS))
    tokens = docs.mapInArrow(_tokenised(tokenizer), f"id long, ids binary, n long, {vectors}")
    tokens = saved(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    moments = tokens.agg(*(f(f"v{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop))).first()
    mean = [float(x or 0) for x in moments[::2]]
    spread = [max(float(x or 0), 1e-6) for x in moments[1::2]]
    narrow = tokens.select("uid", F.col("id").alias("tie"), "n", *(f"v{d}" for d in range(DIMS)))
    keyed = saved(narrow.mapInArrow(_keyed(mean, spread), "uid long, tie long, n long, curve long"), "keys")
    line = keyed.repartitionByRange("curve", "tie", "uid").sortWithinPartitions("curve", "tie", "uid").select("uid", "n").checkpoint()
    totals, at = {}, 0
    for r in line.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).orderBy("p").collect():
        totals[r["p"]], at = at, at + r["n"]
    placed = saved(line.mapInArrow(_offsets(totals), "uid long, at long"), "places")
    out = tokens.select("uid", "id", "ids").join(small(placed), "uid").select("id", "ids", "at")
    return out.mapInArrow(_pieces(length), f"id long, {_PIECES_SQL}")
