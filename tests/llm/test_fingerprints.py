import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import fingerprints as P


def near(a: str, b: str) -> float:
    return max(0.0, float(np.cos(np.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128)))


@pytest.mark.parametrize("ids", [list(range(40)), [5] * 12 + [3, None, None, 9], [1], [7, 7, 7], [None] * 30 + [2, 4], [8] * 25 + [None] * 25])
def test_order_and_edit(spark, ids):
    r = random.Random(len(ids))
    texts = [r.choice([None, "", "é" * 9, " ".join(r.choices(["aa", "Bb", "ç", "dd"], k=r.randint(1, 60)))]) for _ in ids]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, bucket int")
    got = P.digest(docs).collect()
    rank = {r.t: r.h for r in spark.sql("select t, xxhash64(t) h from values " + ", ".join(f"('{t or ''}')" if t is not None else "(null)" for t in texts) + " as x(t)").collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), rank[x[1]], x[1] or ""))
    want = []
    for (i, t), (_, x) in zip(order, order[1:] + order[:1], strict=True):
        t, x = t or "", x or ""
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        f = [P.simhash(s.encode()).tobytes().hex() for s in (t, e, x)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], round(near(f[0], f[1]), 9), round(near(f[0], f[2]), 9)))
    assert sorted(map(str, want)) == sorted(str((*g[:5], round(g[5], 9), round(g[6], 9))) for g in got)
    every = {int(g.fingerprint, 16) for g in got}
    for g in got:
        near_by = sum(0 < (int(g.fingerprint, 16) ^ x).bit_count() <= 3 for x in every)
        assert g.n_within == (near_by if g.doc_id is not None and g.doc_id % 20 == 0 else None)


def test_rows_of_one_id_are_spread():
    r = np.random.default_rng(3)
    ids = np.concatenate([np.full(5000, 7), r.integers(0, 1000, 5000)])
    h = r.integers(-(2**63), 2**63 - 1, 10_000)
    cuts, times = np.unique(np.quantile(ids, np.arange(1, 20) / 20, method="lower").astype(np.int64), return_counts=True)
    at = P.place(ids, h, cuts, times)
    order = np.lexsort((h, -ids))
    assert (np.diff(at[order]) >= 0).all() and np.bincount(at).max() < 1200
    assert (P.place(ids, h, cuts[:0], times[:0]) == 0).all()


def slow_simhash(text: str) -> str:
    """The same vote by vote, from hashes of the words' bytes by their definition."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words, mask = low.split(), 2**64 - 1

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 32

    value = [int(v) for v in np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)]
    base = 0x9E3779B97F4A7C15
    hashed = [mix(sum(value[b] * pow(base, i, 2**64) for i, b in enumerate(w)) & mask) for w in words]
    terms = hashed if len(hashed) < 2 else [mix(a * 3 + (b ^ b >> 7) & mask) for a, b in zip(hashed, hashed[1:], strict=False)]
    votes = [0.0] * 128
    for t in set(terms):
        whole = t | mix(t + base & mask) << 64
        for i in range(128):
            votes[i] += (1 + math.log(terms.count(t))) * (1 if whole >> i & 1 else -1)
    return sum(1 << i for i in range(128) if votes[i] > 1e-9).to_bytes(16, "little").hex()


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c a b", "Été À\tb b b b", "the quick brown fox " * 40, "x" * 5000])
def test_bits_vote_by_vote(text):
    assert P.simhash(text.encode()).tobytes().hex() == slow_simhash(text)


def test_terms_and_likeness():
    assert (P.term_hashes(b"a b a b") == P.term_hashes(b"A  b\ta\nB ")).all() and len(P.term_hashes(b"a b a b")) == 3
    assert not P.simhash(b" \n").any() and P.simhash(b"x").any()
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    a, b = [" ".join(word() for _ in range(400)) for _ in "ab"]
    half = a[: len(a) // 2] + b[: len(a) // 2]
    f = [P.simhash(t.encode()).reshape(1, -1) for t in (a, half, b)]
    assert 0.3 < P.likeness(f[0], f[1])[0] < 0.75 and P.likeness(f[0], f[2])[0] < 0.3 and P.likeness(f[0], f[0])[0] == 1


def test_within_is_brute_force(spark):
    r = random.Random(4)
    fp = [r.getrandbits(128) for _ in range(10)]
    while len(fp) < 200:
        x = r.choice(fp)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(128)
        fp.append(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = spark.createDataFrame([(signed(x >> 64), signed(x & (2**64 - 1))) for x in fp], "hi long, lo long")
    one = lambda a, b: ((a % 2**64) << 64) | (b % 2**64)
    got = {(one(x.q_hi, x.q_lo), one(x.hi, x.lo), x.distance) for x in P.within(rows.limit(60), rows).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in fp[:60] for b in fp if (a ^ b).bit_count() <= 3}


def test_empty(spark):
    assert P.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
