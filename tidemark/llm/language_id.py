"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW`` bytes, from both ends, and gives each byte
probabilities of the languages. A document's are their mean over all of its bytes. It is trained
here, in numpy, by backpropagation through time, on bytes of a bounded sample of labelled documents; it sees
only text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN, WINDOW = 8, 128
#: Labelled documents to train on, about: the first by a hash of their ids.
SAMPLE = 3000
#: Characters of each of them that windows are drawn from; of a longer text, so many pieces spread evenly over all of it.
SAMPLE_CHARS, PIECES = 20_000, 20
STEPS, BATCH, RATE = 800, 192, 0.02
#: How much of the way from equal probabilities to certainty a text's best language must go, or the text is rejected.
MARGIN = 2 / 15
#: Windows that are labelled at once.
LANES = 4096
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    langs: list[str]
    enter: list[np.ndarray]  # of each direction: 256 x 3H, what a byte adds to gates and candidate
    turn: list[np.ndarray]  # H x 3H, what the state adds
    bias: list[np.ndarray]  # H, of the candidate's share of the state
    out: np.ndarray  # 2H x languages
    base: np.ndarray  # languages


def start(langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return Model(langs, [f(256, 3 * hidden), f(256, 3 * hidden)], [f(hidden, 3 * hidden), f(hidden, 3 * hidden)], [np.zeros(hidden, np.float32) for _ in "fb"], f(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def states(x: np.ndarray, enter: np.ndarray, turn: np.ndarray, bias: np.ndarray, keep: list | None = None) -> np.ndarray:
    """State after each byte of x (time x lanes), from the first on. keep: gets what the way back needs."""
    hidden = len(turn)
    h = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((*x.shape, hidden), np.float32)
    for t in range(len(x)):
        a = enter[x[t]]
        u = h @ turn
        gates = a[:, : 2 * hidden] + u[:, : 2 * hidden]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :hidden], gates[:, hidden:]
        s = u[:, 2 * hidden :] + bias
        n = np.tanh(a[:, 2 * hidden :] + r * s)
        if keep is not None:
            keep.append((h, z, r, s, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """Of each byte of x (time x lanes): time x lanes x languages."""
    y = states(x, m.enter[0], m.turn[0], m.bias[0]) @ m.out[: len(m.turn[0])]
    y += states(x[::-1], m.enter[1], m.turn[1], m.bias[1])[::-1] @ m.out[len(m.turn[0]) :]
    y += m.base
    y -= y.max(axis=2, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=2, keepdims=True)
    return y


def gradients(m: Model, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all bytes, and its gradients in the order of parameters()."""
    hidden = len(m.turn[0])
    kept: list[list] = [[], []]
    h = [states(x, m.enter[0], m.turn[0], m.bias[0], kept[0]), states(x[::-1], m.enter[1], m.turn[1], m.bias[1], kept[1])]
    both = np.concatenate([h[0], h[1][::-1]], axis=2)
    y = both @ m.out + m.base
    y -= y.max(axis=2, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=2, keepdims=True)
    lanes = np.arange(x.shape[1])
    loss = float(-np.log(y[:, lanes, label] + 1e-9).mean())
    y[:, lanes, label] -= 1
    y /= x.size
    g_out, g_base = np.tensordot(both, y, ([0, 1], [0, 1])), y.sum(axis=(0, 1))
    back = y @ m.out.T
    grads = []
    for k, g in ((0, back[:, :, :hidden]), (1, back[::-1, :, hidden:])):
        seq = x if k == 0 else x[::-1]
        g_enter, g_turn, g_bias = np.zeros_like(m.enter[k]), np.zeros_like(m.turn[k]), np.zeros_like(m.bias[k])
        d = np.zeros((x.shape[1], hidden), np.float32)
        each = np.empty((*x.shape, 3 * hidden), np.float32)
        for t in range(len(x) - 1, -1, -1):
            d = d + g[t]
            before, z, r, s, n = kept[k][t]
            dn = d * (1 - z) * (1 - n * n)
            a = np.concatenate([d * (before - n) * z * (1 - z), dn * s * r * (1 - r), dn], axis=1)
            each[t] = a
            u = a.copy()
            u[:, 2 * hidden :] *= r
            g_turn += before.T @ u
            g_bias += u[:, 2 * hidden :].sum(axis=0)
            d = d * z + u @ m.turn[k].T
        np.add.at(g_enter, seq.ravel(), each.reshape(-1, 3 * hidden))
        grads += [g_enter, g_turn, g_bias]
    return loss, [grads[0], grads[3], grads[1], grads[4], grads[2], grads[5], g_out, g_base]


def parameters(m: Model) -> list[np.ndarray]:
    return [*m.enter, *m.turn, *m.bias, m.out, m.base]


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, window: int = 64, seed: int = 1) -> Model:
    """A model of the labels' languages, from windows drawn at random; each language is drawn as often."""
    langs = sorted(set(labels))
    m = start(langs or [UNKNOWN], hidden, seed)
    r = np.random.default_rng(seed)
    pools = []
    for lang in langs:
        own = b" ".join(t for t, x in zip(texts, labels, strict=True) if x == lang)
        pools.append(np.frombuffer(own.ljust(window + 1), np.uint8))
    if len(langs) < 2:
        return m
    first, second = [[np.zeros_like(p) for p in parameters(m)] for _ in "12"]
    for i in range(1, steps + 1):
        label = r.integers(0, len(langs), BATCH)
        x = np.stack([pools[k][(a := r.integers(0, len(pools[k]) - window)) : a + window] for k in label], axis=1)
        _, grads = gradients(m, x, label)
        rate = RATE * min(1, 2 * (1 - i / (steps + 1)))
        for p, g, a, b in zip(parameters(m), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return m


def pooled(m: Model, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mean probabilities over all bytes of each text; equal ones for an empty text."""
    total = np.zeros((len(texts), len(m.langs)))
    size = np.array([len(t) for t in texts])
    count = -(-size // window)
    row = np.repeat(np.arange(len(texts)), count)
    lo = window * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    base = np.repeat(np.cumsum(size) - size, count) + lo
    width = np.minimum(window, size[row] - lo)
    every = np.frombuffer(b"".join(texts), np.uint8)
    for k in range(0, len(row), LANES):
        own = slice(k, k + LANES)
        inside = np.arange(window)[:, None] < width[own]
        x = every[np.minimum(base[own] + np.arange(window)[:, None], len(every) - 1)]
        x[~inside] = 32  # spaces behind the last window
        y = probabilities(m, x)
        y *= inside[:, :, None]
        np.add.at(total, row[own], y.sum(axis=0))
    return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 1 / len(m.langs))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs' text and lang. Rows without either are left out; of more than ``sample`` rows, about so many (twice as many at most), those with the least hash of doc_id, are taken."""
    known = docs.where("text is not null and lang is not null").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    n = known.count()
    if n > sample:
        known = known.where(F.col("h") < -(2**63) + int(2**64 * (sample / n)))
    length, each = F.length("text"), SAMPLE_CHARS // PIECES
    piece = lambda i: F.col("text").substr(F.lit(1) + F.floor(i * (length - each) / (PIECES - 1)).cast("int"), F.lit(each))
    spread = F.when(length <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece), " "))
    rows = known.select("h", spread.alias("text"), "lang").distinct().orderBy("h", "text", "lang").limit(2 * sample).collect()
    return train([r.text.encode() for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row. Text that is null or has no letter: ``und``, and score 0. Equal texts have equal results."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = common.text_bytes(b["text"])
            p = pooled(m, texts)
            best = p.argmax(axis=1)
            known = [bool(_LETTER.search(t or "")) for t in b["text"].to_pylist()]
            yield {"doc_id": b["doc_id"], "lang_pred": [m.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known, strict=True)], "score": np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1).round(5), 0.0)}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, m: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose text has letters and whose language's score is margin of the way from equal probabilities to 1, or more. Null and empty texts have no letters."""
    least = 1 / len(m.langs) + margin * (1 - 1 / len(m.langs)) - 1e-6
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            text = b.column(b.schema.names.index("text"))
            known = [bool(_LETTER.search(t or "")) for t in text.to_pylist()]
            yield b.filter(pa.array(np.array(known, bool) & (pooled(m, common.text_bytes(text)).max(axis=1) >= least)))
        common.give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(docs: DataFrame):
    """True for a quarter of the documents, by crc32 of doc_id as text. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out.

    A null doc_id is not held out. Null text or text without letters: und, 0. Rows that repeat each have a row. No rows: no rows.
    """
    own = docs.select("doc_id", "text", "lang")
    return predict(own, fit(own.where(~held_out(own)))).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")
