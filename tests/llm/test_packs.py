import numpy as np
import pyarrow as pa

from fleetlake.llm import kneser_ney as kn


def test_values_go_back_to_a_pack_in_few_rows_and_sum_up():
    """However many batches the join hands over, a task returns one row for each pack and block of values, not one for each batch and text."""
    draw = np.random.default_rng(3)
    texts = np.zeros(50, kn._TEXT)
    texts["key"] = np.array([i.to_bytes(16, "big") for i in range(50)], "V16")
    texts["n"], texts["log"] = np.arange(50), draw.integers(-9, 9, 50)
    pairs = {(int(g), int(t)): int(draw.integers(1, 70_000)) for g, t in zip(draw.integers(0, 400, 5000), draw.integers(0, 49, 5000), strict=True)}
    gram, text = (np.array(x) for x in zip(*pairs, strict=True))
    held = [(gram.astype(np.uint64), text.astype(np.int32), np.array(list(pairs.values()), np.int32))]
    batches = list(kn._pack_rows(7, [texts], held))
    assert sum(b.num_rows for b in batches) == 1 + len(set(gram.tolist()))
    met = pa.Table.from_batches(batches)
    value = {g: int(v) for g, v in zip(range(400), draw.integers(-(1 << 25), 1 << 24, 400), strict=True) if g % 3}
    rows = [(r["pack"], r["at"], r["texts"], r["lists"], None if r["texts"] is not None else value[r["gram"]]) for r in met.to_pylist() if r["texts"] is not None or r["gram"] in value]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
    given = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["pack", "at", "texts", "lists", "value"]).to_batches(max_chunksize=9)
    out = [b for b in kn._found(iter(given)) if b.num_rows]
    assert len(given) > 20 and sum(b.num_rows for b in out) == 2
    got = {r["key"]: (r["n"], r["log"]) for r in kn._pack_sums(pa.Table.from_batches(out)).to_pylist()}
    want = {bytes(t["key"]): (int(t["n"]), int(t["log"]) + sum(value.get(g, 0) * n for (g, x), n in pairs.items() if x == i)) for i, t in enumerate(texts)}
    assert got == want
