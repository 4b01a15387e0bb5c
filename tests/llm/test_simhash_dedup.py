import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_dedup as S
from tidemark.llm.components import components


def slow_fingerprint(text: str) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "a", "A b", "a b c", "a b c d", "Été À b \x85 c\x1cd e\x0bf g", "x y " * 50, "the The THE the"])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def brute(fp: list[int], radius: int = 3) -> list[int]:
    up = list(range(len(fp)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def near(r: random.Random, n: int) -> list[int]:
    out = [0, 2**64 - 1]
    while len(out) < n:
        x = r.choice(out) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("direct", [256, 4])
def test_links_join_as_all_pairs_do(monkeypatch, direct):
    monkeypatch.setattr(S, "DIRECT", direct)
    fp = sorted(set(near(random.Random(5), 200)))
    a, b = S.links(np.array(fp, np.uint64), 3)
    assert len(a) < len(fp)
    up = {x: x for x in fp}
    root = lambda x: x if up[x] == x else root(up[x])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3
        up[root(x)] = root(y)
    want = brute(fp)
    assert len({root(x) for x in fp}) == len(set(want))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_near_links(spark, radius):
    fp = sorted(set(near(random.Random(radius), 300)))
    rows = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fp], "fp long")
    label = {r.node: r.label for r in components(S.near_links(rows, radius)).collect()}
    groups = {}
    for x, k in zip(fp, brute(fp, radius), strict=True):
        s = x - 2**64 if x >= 2**63 else x
        groups.setdefault(k, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 6)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 6: 0, 7: 0}


def test_whole_documents(spark):
    texts = ["a b c d e f g", "a b c d e f g", None, "", " \n", "A B C D E F G", "other words here now"]
    docs = spark.createDataFrame([(i + 3, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d e f g", "x")], "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in S.digest(docs).collect()}
    assert got[3] == got[4] == got[8] == got[None] == 3 and got[5] == got[6] == got[7] == 5 and got[9] == 9
    assert S.digest(docs.where("doc_id < 0")).count() == 0


def edited(r: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.random()}"
    return " ".join(out)


def five(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("small", [64, 2])
def test_wide_forest_joins_as_all_pairs_do(monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    fp = np.array([[x, x ^ 5] for x in sorted(set(near(random.Random(6), 150)))], np.uint64)
    entry = np.sort(np.arange(len(fp)) % 3)
    up = list(range(len(fp)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, j in S.wide_forest(entry, fp, 6):
        assert entry[i] == entry[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 6
        assert root(i) != root(j)
        up[root(i)] = root(j)
    want = sum(len(set(brute([int(a) << 64 | int(b) for a, b in fp[entry == k]], 6))) for k in range(3))
    assert len({root(i) for i in range(len(fp))}) == want


def test_likeness_is_exact_for_few_shingles_and_close_for_many():
    r = random.Random(3)
    for n, off in ((0, 0), (1, 0), (90, 0), (2000, 0.12)):
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for k in (0, min(n, 1), n // 40):
            a, b = " ".join(words), edited(r, words, k)
            want = len(five(a) & five(b)) / len(five(a) | five(b))
            assert abs(S.likeness(S.wide_fingerprint(a.encode())[2], S.wide_fingerprint(b.encode())[2]) - want) <= off + 1e-9


def test_likeness_is_exact_up_to_a_whole_sketch():
    r = random.Random(4)
    for n in (114, 127, 128):  # the union has more than 128
        for k in (1, 2, 3):
            words = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
            a, b = " ".join(words), edited(r, words, k)
            want = len(five(a) & five(b)) / len(five(a) | five(b))
            assert len(five(a)) == len(five(b)) == n
            assert abs(S.likeness(S.wide_fingerprint(a.encode())[2], S.wide_fingerprint(b.encode())[2]) - want) <= 1e-9


@pytest.mark.parametrize("cut", [16_384, 50])
def test_near_copies_of_whole_documents(spark, monkeypatch, cut):
    monkeypatch.setattr(S, "ROWS", cut)
    r = random.Random(8)
    rows, wanted = [], 0
    for g in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 120))]
        size = 100 if g == 0 else 3
        rows += [(1000 * g, " ".join(words))] + [(1000 * g + i, edited(r, words, 1)) for i in range(1, size)]
        wanted += 1
    line = " ".join(["the"] * 90)
    rows += [(10**6, "a b c d e f g h i j " + line), (10**6 + 1, "k l m n o p q r s t " + line), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, "one two")]
    docs = spark.createDataFrame([(*x, "a", "b") for x in rows], "doc_id long, text string, fp string, label string")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    ids = {x.doc_id for x in got.collect()}
    alike = lambda a, b: len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b))
    first = dict(rows)
    assert ids == {d for d, t in rows if d % 1000 == 0 or d >= 10**6} - {10**6 + 3} | {d for d, t in rows if d % 1000 and d < 10**6 and not alike(t, first[d // 1000 * 1000])}
    assert S.one_of_each(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("block", [128, 3])
def test_copies_in_a_family_that_shares_boilerplate(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for family in range(3):  # all share 0.75, the first two of each three 0.81: not the closest fingerprints
        shared = words(90)
        for i in range(0, 360, 10):
            text = shared + words(14)
            other = [f"new{i}-{k}" if k in (20, 50) else w for k, w in enumerate(text)]
            rows += [(1000 * family + i, " ".join(text)), (1000 * family + i + 1, " ".join(other)), (1000 * family + i + 2, " ".join(shared + words(14)))]
    alike = lambda a, b: len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b))
    pairs = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if a // 1000 == b // 1000 and alike(x, y)}
    assert len(pairs) == 108
    got = {x.doc_id: x.component_id for x in S.wide_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if got[a] == got[b]} == pairs


def test_alike_forest_of_two_blocks():
    rows, size = S.sketch_rows([np.array(h, "<u4").tobytes() for h in ([1, 2, 3, 4], [7, 8], [2, 3, 4], [1, 2, 3, 4])])
    assert sorted(S.alike_forest(rows, size, np.zeros(4, np.int64), 0.75)) == [(0, 2), (0, 3)]
    assert S.alike_forest(rows, size, np.array([0, 0, 0, 1]), 0.75) == [(0, 3), (3, 2)]


def test_alike_forest_of_groups():
    rows, size = S.sketch_rows([np.array(h, "<u4").tobytes() for h in ([1, 2, 3, 4], [7, 8], [2, 3, 4], [1, 2, 3, 4], [7, 9])])
    # the second and third are joined already, and by the third all but the last
    assert len(S.alike_forest(rows, size, np.zeros(5, np.int64), 0.75, np.array([5, 3, 3, 5, 4]))) == 1
    assert S.alike_forest(rows, size, np.zeros(5, np.int64), 0.75, np.array([1, 1, 1, 1, 2])) == []


def family_of(spark, hashes: list[list[int]]):
    rows = [(i + 1, 1, bytearray(np.array(sorted(h), "<u4").tobytes())) for i, h in enumerate(hashes)]
    return spark.createDataFrame([(i, k) for i, k, _ in rows], "node long, label long"), spark.createDataFrame([(i, x) for i, _, x in rows], "fp long, sketch binary")


def test_links_of_a_large_group_are_as_many_as_its_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    for n in (60, 120):
        family, distinct = family_of(spark, [[*range(50), 1000 + i] for i in range(n)])
        assert n - 1 <= S.alike_links(family, distinct).count() <= 1.1 * n  # not n * n / BLOCK
    one = distinct.select(F.lit(1).alias("label"), F.lit(1).alias("g"), "fp", "sketch")
    assert S.between_groups(one).count() == 0


def test_texts_meet_all_of_other_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    distinct = family_of(spark, [[i] for i in range(100)])[1]
    own = distinct.select(F.lit(1).alias("label"), F.greatest("fp", F.lit(80)).alias("g"), "fp", F.encode(F.col("fp").cast("string"), "utf-8").alias("sketch"))
    met, tasks = set(), {}
    for x in S.between_groups(own).collect():
        tasks.setdefault((x.i, x.j), []).append((int(x.sketch), x.block))
    for (i, j), rows in tasks.items():
        met |= {tuple(sorted((x, y))) for x, p in rows for y, q in rows if x != y and (i == j or p != q)}
    assert met >= {(x, y) for x in range(1, 101) for y in range(81, 101) if x < y}
    # 20 others in 5 blocks, the 80 in 20 blocks, which don't meet each other
    assert sum(map(len, tasks.values())) == 20 * 25 + 80 * 5


@pytest.mark.parametrize("block", [128, 8, 3])
def test_alike_links_join_as_all_pairs_do(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(block)
    hashes = [set(r.sample(range(10**6), 40))]
    while len(hashes) < 150:
        x = set(r.choice(hashes))
        for _ in range(r.randint(2, 6)):
            x ^= {r.choice(sorted(x)), r.randrange(10**6)}
        hashes.append(x)
    family, distinct = family_of(spark, hashes)
    got = {x.node: x.label for x in components(S.alike_links(family, distinct)).collect()}
    up = list(range(150))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, j in itertools.combinations(range(150), 2):
        if len(hashes[i] & hashes[j]) >= 0.8 * len(hashes[i] | hashes[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    want = [root(i) + 1 for i in range(150)]
    assert [got.get(i + 1, i + 1) for i in range(150)] == want and 1 < len(set(want)) < 150
