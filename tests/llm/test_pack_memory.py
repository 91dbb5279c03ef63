"""Two tasks stand beside an executor's heap: what a task holds for a pack beyond its pairs stays small."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fleetlake.llm import kneser_ney as kn


def test_closing_a_pack_takes_little_beside_its_pairs():
    draw = np.random.default_rng(5)
    texts, held = np.zeros(400, kn._TEXT), []
    for part in range(20):
        both = np.sort(draw.choice(50_000 * 20, 60_000, replace=False))
        gram, text = kn.mix((both // 20).astype(np.uint64)), part * 20 + both % 20
        held.append((gram, text.astype(np.int32), draw.integers(1, 9, len(both)).astype(np.int32)))
    pairs = sum(len(x[0]) for x in held)
    tracemalloc.start()
    rows = sum(b.num_rows for b in kn._pack_rows(0, [texts], held))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows <= 1 + 50_000
    assert peak < 45 * pairs, peak / pairs


def test_taking_n_grams_of_a_text_takes_no_more_for_a_longer_run_of_texts(monkeypatch):
    draw = np.random.default_rng(6)
    texts = ["".join(chr(97 + c) for c in draw.integers(0, 26, 4000)) for _ in range(900)]
    batch = pa.record_batch([pa.array([i.to_bytes(16, "big") for i in range(900)], pa.binary()), pa.array(["en"] * 900), pa.array(texts)], names=["key", "lang", "text"])
    shared = type("Shared", (), {"value": (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.uint64))})
    monkeypatch.setattr(kn, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(kn, "_may_be_known", lambda gram, words: gram % np.uint64(50) == 0)
    tracemalloc.start()
    rows = sum(b.num_rows for b in kn._packs(shared, {}, kn.PACK_PAIRS)(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows > 1 and peak < 190 << 20, peak >> 20


def _held(texts: int, each: int):
    draw = np.random.default_rng(7)
    held = []
    for part in range(20):
        both = np.sort(draw.choice(50_000 * texts, each, replace=False))
        held.append((kn.mix((both // texts).astype(np.uint64)), (part * texts + both % texts).astype(np.int32), draw.integers(1, 9, each).astype(np.uint8)))
    return held


def test_sums_of_a_pack_take_little_beside_its_lists(monkeypatch):
    """And are those of a loop over pairs, whatever is summed up at once; places without a value count nothing."""
    texts, each = 20, 60_000
    held = _held(texts, each)
    want = np.zeros(20 * texts, np.int64)
    grams = np.unique(np.concatenate([x[0] for x in held]))
    values = np.random.default_rng(8).integers(-1000, 1000, len(grams))
    values[-100:] = values[::3] = 0
    for gram, text, times in held:
        np.add.at(want, text, values[np.searchsorted(grams, gram)] * times)
    own = next(kn._pack_rows(0, [np.zeros(20 * texts, kn._TEXT)], held))
    at = np.flatnonzero(values)
    found = kn._joined([kn._squeezed(np.diff(at, prepend=0)), kn._squeezed(values[at].astype(np.int32).view(np.uint32))])
    table = pa.table({"texts": [own.column(3)[0].as_py(), None], "lists": [own.column(4)[0].as_py(), found]})
    tracemalloc.start()
    out = kn._pack_sums(table)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert out["log"].to_numpy().tolist() == want.tolist()
    assert peak < 28 * 20 * each, peak / (20 * each)
    monkeypatch.setattr(kn, "SUM_PAIRS", 1)
    assert kn._pack_sums(table)["log"].to_numpy().tolist() == want.tolist()


def test_a_worker_lets_go_of_what_other_tasks_left():
    from fleetlake.llm import packing, textops

    textops.powers(10)
    packing._ENCODERS["a"] = (None, 1)
    textops.let_go()
    assert len(textops._powers[0]) == 1 and len(textops._powers[1]) == 1 and not packing._ENCODERS
    assert len(textops.powers(10)[0]) == 10


def test_hashing_short_texts_keeps_no_large_tables():
    from fleetlake.llm import partenum, textops

    textops.let_go()
    text = pa.array([f"{i} word " * 30 for i in range(8000)])
    tracemalloc.start()
    rows = sum(b.num_rows for b in partenum._set_rows(5, 80)(iter([pa.record_batch([pa.array(range(8000)), text], names=["id", "text"])])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 8000 and peak < 40 << 20, peak >> 20
    assert len(textops._powers[0]) < 1 << 20
