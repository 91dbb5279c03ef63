import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlake.llm.packing import encoder, hilbert_key, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hilbert_curve_visits_each_cell_once_with_unit_steps():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_pieces_give_back_every_token(request, table):
    df = request.getfixturevalue(table)
    own = Tokenizer.from_file(PATH)
    want = sorted([*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in df.select("text").collect())
    pieces = pack(df, PATH, length=64).collect()
    line = sorted(((p.sequence_id * 64 + p.offset, p) for p in pieces), key=lambda x: x[0])
    at = 0
    whole, current = [], []
    for start, p in line:
        assert start == at and p.length * 4 == len(p.ids) and p.offset + p.length <= 64
        at += p.length
        assert p.start == len(current)
        current += np.frombuffer(p.ids, "<u4").tolist()
        if len(current) == p.doc_tokens:
            whole.append(current)
            current = []
    assert sorted(whole) == want


def test_encoder_agrees_with_the_library(docs):
    own, encode = Tokenizer.from_file(PATH), encoder(PATH)
    for r in docs.limit(50).collect():
        assert encode(r.text) == own.encode(r.text, add_special_tokens=False).ids
    assert zlib.crc32(np.array(encode("a b"), "<u4").tobytes()) > 0
