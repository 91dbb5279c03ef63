"""Language identification by a byte convolutional network written in numpy.

Filters of widths 2, 3 and 4 run over embedded bytes; each filter's largest response in a window of
fixed length feeds a softmax over the languages. A text is all of its windows; their log-probabilities
add up by length. Training runs on a bounded sample of labelled texts (``SAMPLE`` for each language);
prediction runs inside the tasks that hold the texts. Bytes fall into 64 classes, so a trained
filter of width w is a table over class pairs and triples: convolution is a look-up and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small
from .textops import text_chunks

WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
WINDOW = 256
#: Distinct labelled texts drawn for each language at most, those with the smallest hashes; the bound of the training sample.
SAMPLE = 300
#: Windows taken from each sampled text at most.
WINDOWS_OF_TEXT = 3
EPOCHS = 8
CLASSES = 64


def _byte_classes() -> np.ndarray:
    kinds = np.ones(256, np.int64)  # digits, signs
    kinds[[*range(9, 14), 32, *b".,;:!?'\"-()|"]] = 0  # gaps
    for i in range(26):
        kinds[65 + i] = kinds[97 + i] = 2 + i
    kinds[0x80:0xC0] = 28 + np.arange(64) // 2  # continuation bytes, neighbours in pairs
    kinds[[0xC3]] = 60
    kinds[[0xC2, 0xC4, 0xC5]] = 61
    kinds[0xC6:0xE0] = 62
    kinds[0xE0:] = 63
    return kinds


BYTE_CLASSES = _byte_classes()


def _forward(x: np.ndarray, p: dict) -> tuple[np.ndarray, list, np.ndarray]:
    e = p["embed"][x]
    pooled, saved = [], []
    for w in WIDTHS:
        n = x.shape[1] - w + 1
        out = sum(e[:, j : j + n] @ p[f"w{w}"][j] for j in range(w))
        at = out.argmax(1)
        best = np.take_along_axis(out, at[:, None], 1)[:, 0] + p[f"b{w}"]
        pooled.append(np.maximum(best, 0))
        saved.append((at, best))
    hidden = np.concatenate(pooled, 1)
    score = hidden @ p["out"] + p["bias"]
    score -= score.max(1, keepdims=True)
    prob = np.exp(score)
    return prob / prob.sum(1, keepdims=True), saved, hidden


def _windows(text: bytes) -> list[bytes]:
    """Windows spread evenly over the whole text, its first and last bytes included."""
    return [text[at : at + WINDOW] for at in np.unique(np.linspace(0, max(0, len(text) - WINDOW), WINDOWS_OF_TEXT).astype(int))]


def train(texts: list[bytes], labels: list[int], n_labels: int, seed: int = 3) -> dict:
    """Network weights, by Adam over minibatches of windows."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for t, y in zip(texts, labels, strict=True):
        for part in _windows(t):
            part = BYTE_CLASSES[np.frombuffer(part, np.uint8)].astype(np.uint8)
            xs.append(np.pad(part, (0, WINDOW - len(part))))
            ys.append(y)
    x, y = np.array(xs, np.uint8).reshape(-1, WINDOW), np.array(ys, np.int64)
    p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n_labels)), "bias": np.zeros(n_labels)}
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    weight = 1 / np.maximum(np.bincount(y, minlength=n_labels), 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            idx = order[at : at + 64]
            xb, yb = x[idx], y[idx]
            prob, saved, hidden = _forward(xb, p)
            d = prob
            d[np.arange(len(yb)), yb] -= 1
            d *= (weight[yb] / weight[yb].sum())[:, None]
            g = {"out": hidden.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            dh = d @ p["out"].T
            for i, w in enumerate(WIDTHS):
                pos, best = saved[i]
                dp = dh[:, i * FILTERS : (i + 1) * FILTERS] * (best > 0)
                g[f"b{w}"], g[f"w{w}"] = dp.sum(0), np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    kinds = np.take_along_axis(xb, pos + j, 1)
                    g[f"w{w}"][j] = np.einsum("bfe,bf->ef", p["embed"][kinds], dp)
                    np.add.at(g["embed"], kinds, dp[:, :, None] * p[f"w{w}"][j].T[None])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def tables(p: dict) -> dict:
    """The filters' responses to every class pair (widths 2 and 4) and triple (width 3)."""
    e, out = p["embed"], {"out": p["out"], "bias": p["bias"]}
    part = {(w, j): e @ p[f"w{w}"][j] for w in WIDTHS for j in range(w)}
    pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES**2, -1)
    out["two"] = pair(part[2, 0], part[2, 1]) + p["b2"]
    out["three"] = (pair(part[3, 0], part[3, 1])[:, None] + part[3, 2][None]).reshape(CLASSES**3, -1) + p["b3"]
    out["front"], out["back"] = pair(part[4, 0], part[4, 1]) + p["b4"], pair(part[4, 2], part[4, 3])
    return {k: v.astype(np.float32) for k, v in out.items()}


def window_logs(data: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of every window of every text, the window's bytes, and its text's number."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    number = np.arange(len(text)) - first[text]
    used = np.minimum(WINDOW, size[text] - number * WINDOW)
    x = np.zeros(len(text) * WINDOW, np.int32)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size) + np.repeat(first * WINDOW, size)
    x[at] = BYTE_CLASSES[data]
    x = x.reshape(-1, WINDOW)
    two = x[:, :-1] * CLASSES + x[:, 1:]
    three = two[:, :-1] * CLASSES + x[:, 2:]
    pooled = [t["two"][two].max(1), t["three"][three].max(1), (t["front"][two[:, :-2]] + t["back"][two[:, 2:]]).max(1)]
    score = np.maximum(np.concatenate(pooled, 1), 0) @ t["out"] + t["bias"]
    score -= score.max(1, keepdims=True)
    return score - np.log(np.exp(score).sum(1, keepdims=True)), used, text


def _predict(names: list[str], t: dict, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, prob = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, data, offsets in text_chunks(batch.column(0).field(text_col), 1 << 18):
                logs, used, text = window_logs(data, offsets, t)
                n = len(offsets) - 1
                total = np.zeros((n, len(names)))
                np.add.at(total, text, logs * (used / WINDOW)[:, None])
                total -= total.max(1, keepdims=True)
                share = np.exp(total)
                share /= share.sum(1, keepdims=True)
                best[row : row + n], prob[row : row + n] = share.argmax(1), share.max(1)
            has = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            lang = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(has, prob, 0.0))], names=["own", "lang_pred", "score"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_windows(t.as_py().encode()) for t in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["lang", "draw", "parts"])


def training_sample(rows: DataFrame) -> DataFrame:
    """(lang, draw, parts): windows of the SAMPLE distinct texts of each language in ``rows`` (lang, text) with the smallest hashes."""
    rows = rows.select("lang", F.xxhash64("text").alias("draw"), "text")
    texts = saved(rows.select("lang", "draw").distinct(), "texts")
    sizes = saved(texts.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    # hashes are spread evenly, so the least 300 are looked for among the some 1200 below a limit; else one task would rank all of a language
    share = F.col("draw") / F.lit(2.0**64) + 0.5
    low = texts.join(small(sizes), "lang").where(share * F.col("n") <= 4 * SAMPLE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = saved(low.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "draw"), "chosen")
    drawn = rows.join(small(chosen), ["lang", "draw"], "left_semi").mapInArrow(_cut, "lang string, draw long, parts array<binary>")
    return drawn.groupBy("lang", "draw").agg(F.first("parts").alias("parts"))


def predict_languages(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row of ``docs`` (own columns) with lang_pred and score, learned from ``learn_from`` (text, lang).

    Every language is learned, from its SAMPLE distinct texts with the smallest hashes (all if it has
    fewer; copies count once), each by windows spread over the whole text; texts without a language or
    a letter are left out.
    A null text, one without a letter, and any text when nothing could be learned, is ``und`` with
    score 0. Whole texts are judged, window by window; rows are judged one by one.
    """
    rows = learn_from.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(r"lang is not null and text rlike '\\p{L}'")
    drawn = sorted(training_sample(rows).toArrow().to_pylist(), key=lambda r: (r["lang"], r["draw"]))
    names = sorted({r["lang"] for r in drawn})
    weights = None
    if names:
        number = {k: i for i, k in enumerate(names)}
        pieces = [(part, number[r["lang"]]) for r in drawn for part in r["parts"]]
        weights = tables(train([x for x, _ in pieces], [y for _, y in pieces], len(names)))
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if weights is None:
        return docs.select(*own, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    given = docs.select(F.struct(*own).alias("own"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has"))
    kind = given.schema["own"].dataType.simpleString()
    out = given.mapInArrow(_predict(names, weights, text_col), f"own {kind}, lang_pred string, score double")
    return out.select("own.*", "lang_pred", "score")
