import math
import re
from collections import defaultdict

import pytest

from tidemark.llm import mixing as M


def wanted(sizes: dict) -> dict:
    """Words wanted of each source, by filling up and dealing out again until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, 1.5 * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in above]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 0, None: 500}, {"é": 1, "z": 1, "Z": 1}, {"x": 8}, {"Z": 100, "z": 100, "é": 100}, {f"s{i}": (i * 37) % 91 for i in range(60)}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r.source: (r["rank"], r.target) for r in M.with_targets(M.ranked(rows)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert {s: k for s, (k, _) in got.items()} == {s: i for i, s in enumerate(order)}
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(wanted(sizes))


@pytest.mark.parametrize("sent", [10_000, 0])
def test_multipliers_are_logarithms(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "SENT", sent)
    docs = spark.createDataFrame([("a", 3), ("a", 5), (None, 7), ("b", 1000), ("c", 0)], "source string, size long")
    want = {"a": 16.0, None: 3.5, "b": 4000.0, "c": 0.0}
    sources = spark.createDataFrame(list(want.items()), "source string, target double")
    got = {r.source: r.m for r in M.multipliers(docs, sources, 4).collect()}
    assert got.pop("c") is None
    assert got == pytest.approx({"a": math.log(16 / 8), None: math.log(3.5 / 7), "b": math.log(4)}, abs=1e-9)


@pytest.mark.parametrize("block", [20_000, 7])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    src = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s, n = src[r.doc_id]
        assert r.size == n and r.taken in (0, n, 2 * n)
        total[s] += n
        taken[s] += r.taken
        target[s] = r.target
    assert len(rows) == len(src) and target == pytest.approx(wanted(dict(total)))
    assert all(r.source_size == total[src[r.doc_id][0]] for r in rows)
    assert all(abs(taken[s] - t) <= (0.02 if block > 7 else 0.2) * t for s, t in target.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(docs.repartition(5)).collect()))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9), (1, "a b c", "s", 9), (2, None, None, 1), (None, "x y z", None, 2), (3, "", "t", 3)], "doc_id long, text string, source string, size int")
    rows = {(r.doc_id, r.size): r for r in M.mix(docs).collect()}
    assert rows[(1, 3)].source_size == 6 and rows[(None, 2)].source_size == 2 and rows[(3, 0)].taken == 0 and rows[(2, 0)].target == rows[(None, 2)].target
    assert M.mix(docs.where("doc_id < 0")).count() == 0
    got = M.copies(docs)
    assert got.columns == docs.columns and {r.size for r in got.collect()} <= {9, 2}
    assert got.count() == sum(r.taken // r.size for r in M.mix(docs).collect() if r.size)
