"""Two tokenizers' tokens linked where they cover the same bytes, and how often each link holds in the corpus.

A chunk of whole texts is tokenised once by both; byte offsets at which tokens of both end cut the
tokens into groups, and every two tokens of a group are linked. Each chunk writes what it holds as
runs, one for each radix (the low bits of the first tokenizer's id): pairs in order of the first id,
then the second, with their documents, packed and compressed with zstd. A heap merges the runs of a
radix block by block, so that each pair's documents are counted while only one block of each run is
unpacked. As one first id's pairs are neighbours, its highest count is known as soon as they have
passed. The counts then go over the runs once more, pair by pair in the same order, and what they
add to each document streams back to the chunks. A slice of chunks bounds what a task takes, so a
token that stands in every document is spread over tasks like any other.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bytes of text in a chunk; a longer text is a chunk of its own. Documents in it, at most.
CHUNK_BYTES = 2 << 20
CHUNK_DOCS = 1 << 15
#: Runs of a chunk, as bits of the first id.
RADIX_BITS = 5
#: Chunks whose runs a task merges.
SLICE = 512
#: Pairs of a block of a run.
BLOCK = 1 << 14

_encoders: dict[tuple[str, str], tuple] = {}


def byte_tokens(path: str):
    """(encode, table): ids of a byte-level BPE vocabulary, special tokens' strings being plain text, and the bytes of each id.

    The ranks of the merges are the ids; where a probe text or a text that the rank-based encoder can't
    take differs, the file's own library encodes.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from .packing import _PATTERN, _printable_bytes, guarded

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    to_byte = _printable_bytes()
    words = {i: bytes(map(to_byte.__getitem__, w)) for w, i in spec["model"]["vocab"].items() if w not in special}
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={w: i for i, w in words.items()}, special_tokens={})
    probe = " The naïve  fox's\n\n\t12345 中文 \U0001f600 don't... ÀÉ|###!! " + " ".join(special)
    if not np.array_equal(np.array(fast.encode_ordinary(probe)), slow(probe)):
        return slow, words

    return guarded(lambda text: np.array(fast.encode_ordinary(text), np.uint32), slow), words


def piece_tokens(path: str):
    """(encode, table): ids of a sentence-piece model and the bytes of each id: U+2581 is a space, <0xHH> a byte."""
    import re

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        words[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()
    return lambda text: np.array(model.encode(text), np.uint32), words


def _both(paths: tuple[str, str]):
    """Per worker: (encode, bytes of each id, their lengths) of either tokenizer, and the decimal digits of ids."""
    if paths not in _encoders:
        sides = []
        for encode, words in (byte_tokens(paths[0]), piece_tokens(paths[1])):
            table = [words.get(i, b"\xff\xff") for i in range(max(words) + 2)]
            sides.append((encode, table, np.array([len(w) for w in table], np.int64)))
        n = max(len(s[1]) for s in sides)
        digits = np.zeros((n, 6), np.uint8)  # zeros are left out again; the last place is for what follows the id
        for i in range(n):
            text = str(i).encode()
            digits[i, : len(text)] = np.frombuffer(text, np.uint8)
        _encoders[paths] = (*sides, digits)
    return _encoders[paths]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one zstd frame; each takes the fewest bytes that hold it."""
    parts = [np.array([len(columns)], "<u8").tobytes()]
    for c in columns:
        most = int(c.max()) if len(c) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        parts += [np.array([len(c), width], "<u8").tobytes(), c.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them), for all i."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(start - total + n, n)


def groups(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every token of either side; both sides cover the same bytes."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    cut = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool)
    cut[end_a] = True
    common_b = cut[end_b]
    cut[:] = False
    cut[end_b] = True
    common_a = cut[end_a]
    return np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b


def _digests(a, b, ga, gb, digits, doc_of_group, docs: int) -> list[str]:
    """For each document the SHA-256 of its groups' ids; '' for one without tokens."""
    n_groups = len(doc_of_group)
    size_a, size_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    at_a, at_b = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + (before_a + size_a)[gb]
    line = np.empty((len(a) + len(b), digits.shape[1]), np.uint8)
    line[at_a], line[at_b] = digits[a], digits[b]
    line[:, -1] = ord(",")
    line[(before_a + before_b + size_a) - 1, -1] = ord("|")
    ends = before_a + before_b + size_a + size_b
    line[ends - 1, -1] = ord(";")
    last = np.flatnonzero(np.diff(doc_of_group, append=docs))
    line[ends[last] - 1, -1] = 0
    flat = line.reshape(-1)
    stop = np.cumsum((line != 0).sum(1))[ends[last] - 1]
    text = flat[flat != 0].tobytes()
    out, at = [""] * docs, 0
    for d, end in zip(doc_of_group[last].tolist(), stop.tolist(), strict=True):
        out[d] = hashlib.sha256(text[at:end]).hexdigest()
        at = end
    return out


def _links(a, b, ga, gb, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, a, b, links) of all pairs of tokens that share a group; large groups by distinct ids, some million pairs at a time."""
    size_a, size_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    product = size_a * size_b
    large = product > 4096
    if large.any():
        for g in np.flatnonzero(large):
            ids_a, n_a = np.unique(a[np.searchsorted(ga, g) : np.searchsorted(ga, g, "right")], return_counts=True)
            ids_b, n_b = np.unique(b[np.searchsorted(gb, g) : np.searchsorted(gb, g, "right")], return_counts=True)
            for i in range(0, len(ids_a), step := max(1, (1 << 20) // len(ids_b))):
                x, m = ids_a[i : i + step], n_a[i : i + step]
                yield np.full(len(x) * len(ids_b), g), np.repeat(x, len(ids_b)), np.tile(ids_b, len(x)), np.repeat(m, len(ids_b)) * np.tile(n_b, len(x))
    first_b = np.cumsum(size_b) - size_b
    use = ~large[ga]
    x, g = a[use], ga[use]
    n_links = np.cumsum(size_b[g])
    stops = np.searchsorted(n_links, np.arange(1 << 21, (int(n_links[-1]) if len(x) else 0) + (1 << 21), 1 << 21), "right")
    for start, stop in zip([0, *stops[:-1]], stops, strict=True):
        y, h = x[start:stop], g[start:stop]
        n = size_b[h]
        yield np.repeat(h, n), np.repeat(y, n), b[spread(first_b[h], n)], np.ones(int(n.sum()), np.int64)


_RUN = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("digest", pa.string()), ("radix", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary())])
_RUN_SQL = "kind byte, chunk long, place int, id long, n_a long, n_b long, n_groups long, n_links long, digest string, radix int, pairs binary, docs binary"


def _chunk_rows(chunk: int, ids: list, texts: list[str], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0) and one for each radix (kind 1) of a chunk."""
    (encode_a, table_a, len_a), (encode_b, table_b, len_b), digits = _both(paths)
    docs, sides = len(texts), ([], [])
    n_a, n_b = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for d, text in enumerate(texts):
        if text:
            a, b, given = encode_a(" " + text), encode_b(text), b" " + text.encode()
            if b"".join(map(table_a.__getitem__, a.tolist())) == given == b"".join(map(table_b.__getitem__, b.tolist())):
                n_a[d], n_b[d] = len(a), len(b)
                sides[0].append(a)
                sides[1].append(b)
    a, b = (np.concatenate([np.zeros(0, np.uint32), *s]).astype(np.int64) for s in sides)
    ga, gb = groups(a, b, len_a, len_b)  # a text's end is an end on both sides, so no group crosses it
    n_all = int(ga[-1]) + 1 if len(a) else 0
    doc_of_group = np.zeros(n_all, np.int64)
    doc_of_group[ga] = np.repeat(np.arange(docs), n_a)
    digests = _digests(a, b, ga, gb, digits, doc_of_group, docs) if n_all else [""] * docs
    n_links = np.bincount(doc_of_group, np.bincount(ga, minlength=n_all) * np.bincount(gb, minlength=n_all), docs).astype(np.int64)
    none = lambda n, kind: pa.nulls(n, kind)
    columns = [np.zeros(docs, np.int8), np.full(docs, chunk), np.arange(docs, dtype=np.int32), None, n_a, n_b, np.bincount(doc_of_group, minlength=docs), n_links]
    yield pa.record_batch([*(pa.array(ids, pa.int64()) if c is None else pa.array(c, f.type) for c, f in zip(columns, _RUN, strict=False)), pa.array(digests, pa.string()), none(docs, pa.int32()), none(docs, pa.binary()), none(docs, pa.binary())], schema=_RUN)
    # keys in order of radix, first id, second id, document
    held = [np.zeros((2, 0), np.int64)]
    low = (1 << RADIX_BITS) - 1
    for g, x, y, m in _links(a, b, ga, gb, n_all):
        key = ((x & low) << 49) | ((x >> RADIX_BITS) << 33) | (y << 16) | doc_of_group[g]
        if (m == 1).all():
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            held.append(np.stack([key[first], np.diff(first, append=len(key))]))
        else:
            key, at = np.unique(key, return_inverse=True)
            held.append(np.stack([key, np.bincount(at, m, len(key)).astype(np.int64)]))
    key, m = held[1] if len(held) == 2 else np.concatenate(held, 1)
    if len(held) > 2:
        key, at = np.unique(key, return_inverse=True)
        m = np.bincount(at, m, len(key)).astype(np.int64)
    bounds = np.searchsorted(key, np.arange(low + 2) << 49)
    radix, heads, bodies = [], [], []
    for r in range(low + 1):
        k, n = key[bounds[r] : bounds[r + 1]], m[bounds[r] : bounds[r + 1]]
        if len(k):
            pair = (k >> 16) & (1 << 33) - 1
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            count, doc = np.diff(first, append=len(pair)), k & 0xFFFF
            pair = pair[first]
            blocks = range(0, len(pair), BLOCK)
            radix.append(r)
            heads.append(_framed([pack(np.diff(pair[i : i + BLOCK], prepend=0), count[i : i + BLOCK]) for i in blocks]))
            ends = np.append(first, len(doc))
            bodies.append(_framed([pack(doc[ends[i] : ends[min(i + BLOCK, len(pair))]], n[ends[i] : ends[min(i + BLOCK, len(pair))]]) for i in blocks]))
    n = len(radix)
    yield pa.record_batch([pa.array(np.ones(n, np.int8)), pa.array(np.full(n, chunk)), *(none(n, f.type) for f in list(_RUN)[2:9]), pa.array(radix, pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], schema=_RUN)


def _framed(blocks: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blocks)


def _blocks(data: bytes) -> Iterator[list[np.ndarray]]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        yield unpack(data[at + 4 : at + 4 + n])
        at += 4 + n


def _runs(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if texts and (size + len(text) > CHUNK_BYTES or len(texts) == CHUNK_DOCS):
                    yield from _chunk_rows(chunk, ids, texts, paths)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield from _chunk_rows(chunk, ids, texts, paths)

    return run


def merged(runs: list[Iterable[list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts), ascending, of runs of (pairs, counts) blocks: counts of equal pairs are added.

    The heap holds the last pair of each run's current block; up to the smallest of these all blocks
    are complete, so that much of each is taken.
    """
    sources, heap, blocks = [iter(r) for r in runs], [], {}

    def load(i: int) -> None:
        block = next(sources[i], None)
        if block is None:
            blocks.pop(i, None)
        else:
            blocks[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(sources)):
        load(i)
    while heap:
        bound = heap[0][0]
        pairs, counts = [], []
        for i, (p, c) in blocks.items():
            n = int(np.searchsorted(p, bound, "right"))
            if n:
                pairs.append(p[:n])
                counts.append(c[:n])
                blocks[i] = [p[n:], c[n:]]
        while heap and heap[0][0] == bound:
            load(heapq.heappop(heap)[1])
        pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
        yield pairs, np.bincount(at, np.concatenate(counts), len(pairs)).astype(np.int64)


def _heads(blobs: Iterable[bytes]) -> list[Iterator[list[np.ndarray]]]:
    return [([np.cumsum(p), c] for p, c in _blocks(x)) for x in blobs]


def _partial(table: pa.Table) -> pa.Table:
    """The merged counts of a slice's runs of one radix."""
    blocks = [pack(np.diff(p[i : i + BLOCK], prepend=0), c[i : i + BLOCK]) for p, c in merged(_heads(x.as_py() for x in table["pairs"])) for i in range(0, len(p), BLOCK)]
    return pa.table([table["radix"].slice(0, 1), pa.array([_framed(blocks)], pa.binary())], names=["radix", "pairs"])


def _final(table: pa.Table) -> pa.Table:
    """Counts of all slices of one radix: a block's pairs, counts, and whether the count is its first id's highest.

    Pairs come in order of their first id; those of the last one wait until the next id begins.
    """
    out, wait = [], [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def settle(p: np.ndarray, c: np.ndarray) -> None:
        if len(p):
            _, first = np.unique(p >> 17, return_index=True)
            most = np.repeat(np.maximum.reduceat(c, first), np.diff(first, append=len(p)))
            for i in range(0, len(p), BLOCK):
                s = slice(i, i + BLOCK)
                out.append(pack(np.diff(p[s], prepend=0), c[s], (c == most)[s]))

    for p, c in merged(_heads(x.as_py() for x in table["pairs"])):
        p, c = np.concatenate([wait[0], p]), np.concatenate([wait[1], c])
        n = int(np.searchsorted(p >> 17, p[-1] >> 17))
        settle(p[:n], c[:n])
        wait = [p[n:], c[n:]]
    settle(*wait)
    return pa.table([table["radix"].slice(0, 1), pa.array([_framed(out)], pa.binary())], names=["radix", "counts"])


def _contributions(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """(chunk, sums): what one radix's pairs add to n_best and count_sum of each document of a slice's chunks."""
    if not runs.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["chunk", "sums"])
    known = [np.concatenate(x) for x in zip(*(([np.cumsum(p), c, best]) for p, c, best in _blocks(counts["counts"][0].as_py())), strict=True)]
    chunks, sums = [], []
    for chunk, head, body in zip(runs["chunk"].to_pylist(), runs["pairs"], runs["docs"], strict=True):
        best = total = np.zeros(0, np.int64)
        for (p, n), (doc, links) in zip(_heads([head.as_py()])[0], _blocks(body.as_py()), strict=True):
            at = np.searchsorted(known[0], p)
            docs = max(len(best), int(doc.max()) + 1)
            best = np.pad(best, (0, docs - len(best))) + np.bincount(doc, links * np.repeat(known[2][at], n), docs).astype(np.int64)
            total = np.pad(total, (0, docs - len(total))) + np.bincount(doc, links * np.repeat(known[1][at], n), docs).astype(np.int64)
        chunks.append(chunk)
        sums.append(pack(best, total))
    return pa.table([pa.array(chunks, pa.int64()), pa.array(sums, pa.binary())], names=["chunk", "sums"])


def _collected(docs: pa.Table, sums: pa.Table) -> pa.Table:
    best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    for x in sums["sums"]:
        b, t = unpack(x.as_py())
        best[: len(b)] += b
        total[: len(t)] += t
    place = docs["place"].to_numpy()
    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place])).append_column("groups_sha256", docs["digest"])


def align(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A tokens are those of ' ' and the text by the byte-level vocabulary file ``byte_bpe``, B tokens those
    of the text by the sentence-piece model ``pieces``. ``n_links`` counts the pairs of token
    occurrences that share a group, ``count_sum`` adds up, over them, how many rows of the table hold
    the pair of ids linked, ``n_best`` counts those whose count is the highest of their A id, ties
    included. The digest is of 'a1,a2|b1;a3|b2' over the groups in order. Null and empty texts, and those
    whose tokens do not give back the text, have no tokens: zeros and ''. Repeated rows count each; a
    text of any length is one chunk; an empty table gives no rows.
    """
    paths = (byte_bpe, pieces)
    runs = saved(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_runs(paths), _RUN_SQL), "runs")
    pairs = runs.where("kind = 1")
    slices = max(1, -(-pairs.select("chunk").distinct().count() // SLICE))
    part = F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int").alias("part")
    partial = pairs.select("radix", part, "pairs").groupBy("radix", "part").applyInArrow(_partial, "radix int, pairs binary")
    counts = saved(partial.groupBy("radix").applyInArrow(_final, "radix int, counts binary"), "counts")
    copies = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    mine = pairs.select("radix", part, "chunk", "pairs", "docs").groupBy("radix", "part")
    sums = mine.cogroup(copies.groupBy("radix", "part")).applyInArrow(_contributions, "chunk long, sums binary")
    own = runs.where("kind = 0").select("chunk", "place", "id", "n_a", "n_b", "n_groups", "n_links", "digest")
    return own.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_collected, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
