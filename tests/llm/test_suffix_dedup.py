import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S


def made(seed: int) -> list[bytes]:
    r = random.Random(seed)
    word = lambda: bytes(r.choices(b"abcde", k=r.randint(1, 6)))
    text = lambda n: b" ".join(word() for _ in range(n))
    shared = [text(r.randint(5, 40)) for _ in range(4)]
    out = [text(r.randint(0, 30)) + r.choice(shared)[r.randint(0, 30) :] + text(r.randint(0, 30)) for _ in range(25)]
    return out + [b"ab" * 120, b"x" * 90, b"", b"q", out[3], out[3], out[4] + b"!", b"abcabcabc" * 30]


@pytest.mark.parametrize("seed", range(12))
def test_minimizers_cover_every_window_once(seed):
    texts, length, gram = made(seed), 40, 20
    for t in texts:
        b = np.frombuffer(t, np.uint8)
        at, lo, hi, _ = S.minimizers(b, np.array([len(b)]), length, gram)
        windows = sorted(int(a) - d for a, x, y in zip(at, lo, hi, strict=True) for d in range(x, y + 1))
        assert windows == list(range(max(0, len(t) - length + 1)))


def test_merge_is_sort():
    r = random.Random(1)
    strings = [bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(500)]
    runs = []
    for i in range(7):
        own = sorted(strings[i::7])
        runs.append((own, S.front_code(own)[0].tolist()))
        assert list(S.front_decode(*S.front_code(own))) == own
    out = list(S.merge([iter(zip(*r, strict=True)) for r in runs]))
    assert [x for _, x, _ in out] == sorted(strings) and all([x for r, x, _ in out if r == k] == runs[k][0] for k in range(7))
    assert [k for _, _, k in out] == [0] + [S.shared(a, b, 0) for (_, a, _), (_, b, _) in zip(out, out[1:], strict=False)]


def test_spans_that_meet_are_one():
    x = np.array([(2, 1, 5, 9), (1, 1, 0, 4), (1, 1, 4, 6), (1, 1, 1, 3), (1, 1, 8, 9), (1, 2, 3, 4), (2, 1, 6, 7)], S._SPAN)
    assert S.joined(x).tolist() == [(1, 1, 0, 6), (1, 1, 8, 9), (1, 2, 3, 4), (2, 1, 5, 9)] and len(S.joined(x[:0])) == 0


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "GROUPED", [1, 7, 20_000][seed % 3])
    monkeypatch.setattr(S, "RUN_BYTES", 3_000 if seed % 2 else 48 << 20)
    texts = made(seed)
    docs = spark.createDataFrame([(i % 31, t.decode()) for i, t in enumerate(texts)] + [(77, None), (None, None), (None, "z" * 50)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(docs, 40).collect()}
    every = [*texts, b"", b"", b"z" * 50]
    ids = [*[i % 31 for i in range(len(texts))], 77, None, None]
    want = {(i, len(t), len(t) - len(k), k) for i, t, k in zip(ids, every, S.brute_force(every, 40), strict=True)}
    assert got == want


def test_rows_that_repeat_are_copies(spark):
    docs = spark.createDataFrame([(1, "abc" * 30, 0)] * 3 + [(1, "short", 1)] * 2 + [(2, "é" * 40, 0)], "doc_id long, text string, kd int")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(docs, 60).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got[-1] == (2, 80, 80, 1, none) and got[:3] != got[1:4]
    assert [g for g in got if g[1] == 90] == [(1, 90, 90, 1, none)] * 3
    assert [g[2] for g in got if g[1] == 5] == [0, 0]


def test_empty(spark):
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
