import zlib

import numpy as np

from tidemark.llm import language_id as L


def test_gradients_are_those_of_the_loss():
    m = L.start(["a", "b", "c"], hidden=3)
    for name in ("enter", "turn", "bias"):
        setattr(m, name, [p.astype(np.float64) for p in getattr(m, name)])
    m.out, m.base = m.out.astype(np.float64), m.base.astype(np.float64)
    r = np.random.default_rng(0)
    x, label = r.integers(97, 102, (7, 5)).astype(np.uint8), r.integers(0, 3, 5)
    _, grads = L.gradients(m, x, label)
    for p, g in zip(L.parameters(m), grads, strict=True):
        flat = [i for i in np.ndindex(p.shape) if abs(g[i]) > 1e-4][:6]
        for i in flat:
            old, eps = p[i], 1e-2
            p[i] = old + eps
            up = L.gradients(m, x, label)[0]
            p[i] = old - eps
            down = L.gradients(m, x, label)[0]
            p[i] = old
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-3 + 0.05 * abs(g[i])


def test_pooled_is_the_mean_of_windows():
    m = L.start(["a", "b"])
    texts = [b"", b"x", bytes(range(97, 120)) * 20, b"hello there" * 3]
    got = L.pooled(m, texts)
    for t, p in zip(texts, got, strict=True):
        want = np.zeros(2) if t else np.full(2, 0.5)
        for i in range(0, len(t), 128):
            x = np.frombuffer(t[i : i + 128].ljust(128), np.uint8)[:, None]
            want = want + L.probabilities(m, x)[: len(t) - i].sum(axis=(0, 1)) / len(t)
        assert np.allclose(p, want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_nulls_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "die und der", "de", 0), (2, "the of and", "en", 0), (2, "the of and", None, 1), (None, None, "en", 1), (4, "", "de", 1), (5, "12 .. !", None, 0)], "doc_id long, text string, lang string, score int")
    rows = L.digest(docs).collect()
    assert len(rows) == 6 and {r.lang_pred for r in rows if r.doc_id in (None, 4, 5)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 2}) == 1
    assert L.digest(docs.where("doc_id < 0")).count() == 0
    assert {r.lang_pred for r in L.digest(docs.withColumn("lang", docs["lang"].substr(9, 9)).where("lang is null")).collect()} == {"und"}
