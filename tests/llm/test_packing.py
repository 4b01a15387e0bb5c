import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing as P


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


TEXTS = ["", " ", "Hello, it's 2024! don't", "İstanbul ΣΑΣ ΣΑΣ\x1cx\x1dy\x85z　w", "a<|endoftext|>b <|startoftext|>", "é ́x", "x" * 5000, " ᠎​﻿ mixed\xa0space", "日本語テキスト 123 ４５", "a. b.. c.' d_. ½. é, f.", "'s 't a's\t\n\r\x0b\x0c\x1fq"]


def test_ids_are_the_tokenizers():
    t = tokenizer()
    r = random.Random(3)
    chars = [*"aAsStTlL' \t\n.,!0123<|>_½;", "é", "É", "́", "ß", "Σ", "\x1c", "\x85", " ", "😀"]
    texts = TEXTS + ["".join(r.choices(chars, k=r.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, P.encode(texts, P.tokenizer_path()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_and_fits(seed):
    r = np.random.default_rng(seed)
    lengths = np.unique(r.integers(1, 2049, [5, 60, 400, 1500, 2, 1][seed]))
    counts = r.integers(1, [3, 50, 2000, 30, 7, 1][seed], len(lengths)) if seed != 5 else np.array([9])
    size, patterns, uses = P.plan(lengths, counts)
    assert (patterns @ size <= 256).all() and (uses > 0).all()
    want = np.bincount(np.searchsorted(size, -(-lengths // 8)), counts, minlength=len(size))
    assert (uses @ patterns == want).all()
    _, x = P.solve(size, want.astype(float), 256)  # the best that any packing can do
    assert uses.sum() <= 1.001 * x.sum() + 0.6 * len(size) + 1


def test_program_meets_a_known_optimum():
    patterns, x = P.solve(np.array([3, 5, 7]), np.array([30.0, 30.0, 30.0]), 15, gap=1e-9)
    assert abs(x.sum() - 30) < 1e-6 and (patterns @ np.array([3, 5, 7]) <= 15).all()


def test_whole_documents(spark):
    r = random.Random(1)
    texts = [*TEXTS, None, *(" ".join(r.choices(["alpha", "beta", "of", "zq9"], k=r.choice([3, 40, 900, 3000]))) for _ in range(120))]
    docs = spark.createDataFrame([(i % 100, t, "clash") for i, t in enumerate(texts)] + [(None, "x y", "")], "doc_id long, text string, length string")
    rows = P.digest(docs).collect()
    t, want = tokenizer(), defaultdict(list)
    for i, x in [*((i % 100, x) for i, x in enumerate(texts)), (None, "x y")]:
        want[i].append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    got, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        got[x.doc_id].append((x.start, x.length, x.ids_crc32, x.doc_tokens))
        sequences[x.sequence_id].append((x.offset, x.length))
    for i, docs_of in want.items():
        assert sorted(got[i]) == sorted((s, len(d[s : s + 2048]), zlib.crc32(np.array(d[s : s + 2048], "<u4").tobytes()), len(d)) for d in docs_of for s in range(0, len(d), 2048))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_empty(spark):
    assert P.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
