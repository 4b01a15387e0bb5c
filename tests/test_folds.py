"""Folds of matches against plain loops, and that rows which predicates see alike are compared once, whatever their number."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggs as A
from tidemark.functions import predicates as K
from tidemark.operators import joins as J
from tidemark.operators.ordered import OrderedFrame

from .test_intervals import CASES, ROWS, df, same  # noqa: F401

FOLDS = {"n": A.tally(), "total": A.summed("score"), "first": A.least("id"), "last": A.most("id")}


def brute(u, test):
    ids = [v[6] for v in ROWS if same(v, u) and test(v, u)]
    return (u[6], len(ids), sum(ids), min(ids, default=None), max(ids, default=None))


@pytest.mark.parametrize("name", CASES)
def test_folds(df, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(J, "STRETCH", 4)
    pred, test = CASES[name]
    rows = J.folded(df, df, pred, folds=FOLDS).collect()
    assert sorted((r.id, r.n, r.total, r.first, r.last) for r in rows) == sorted(brute(u, test) for u in ROWS)
    if pred.span:  # sums alone go another way
        rows = J.folded(df, df, pred, folds={"n": A.tally(), "total": A.summed("score")}).collect()
        assert sorted((r.id, r.n, r.total) for r in rows) == sorted(brute(u, test)[:3] for u in ROWS)


@pytest.mark.parametrize("pred", [K.LT, K.LTEQ, K.GT, K.GTEQ, K.EQ, K.dleq(1), K.LTEQ & K.dg(1), K.szpercent(1.6)], ids=lambda p: p.name)
def test_points_with_missing_values(spark, pred):
    values = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (None, "a"), (2, "b"), (5, "b"), (5, None), (None, None)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, x int, k string")
    got = J.folded(rows, rows, pred, folds=FOLDS | {"total": A.summed("id")}, by=("k",), chrom=None, start="x", end="x")
    u, v = J.side("", None, "x", "x"), J.side("r_", None, "x", "x")
    want = rows.join(J.prefixed(rows), pred(v, u) & (F.col("k") == F.col("r_k")), "left").groupBy("id").agg(F.count("r_id").alias("n"), F.coalesce(F.sum("r_id"), F.lit(0)).alias("total"), F.min("r_id").alias("first"), F.max("r_id").alias("last"))
    cols = ["id", "n", "total", "first", "last"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def same_parts(spark, n=60_000):
    """So many rows of three places that all pairs would be 1.2 thousand millions."""
    return OrderedFrame(spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("x"), F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("brand")), ("x",))


def only(df, *cols):  # noqa: F811
    """The distinct values of cols, and how often they are there."""
    return sorted((*r[:-1], r[-1]) for r in df.groupBy(*cols).count().collect())


def test_points_that_are_alike_are_compared_once(spark):
    o = same_parts(spark)
    fold = lambda *preds, **how: only(o.join(o).fold(*preds, by=("k",), n=A.tally(), first=A.least("id"), **how), "x", "n", "first")
    assert fold(K.EQ) == [(x, 20_000, x, 20_000) for x in range(3)]
    assert fold(K.LT) == [(0, 0, None, 20_000), (1, 20_000, 0, 20_000), (2, 40_000, 0, 20_000)]
    assert fold(K.dleq(1), K.GT) == [(0, 20_000, 1, 20_000), (1, 20_000, 2, 20_000), (2, 0, None, 20_000)]
    assert fold(K.EQ, where=lambda: F.col("brand") != F.col("r_brand"), sees=("brand",)) == [(x, 10_000, y, 10_000) for x in range(3) for y in sorted((x, x + 3))]


def test_any_function_of_points_that_are_alike(spark):
    o = same_parts(spark)
    out = o.join(o).using(lambda v, u: (v.start * 2 >= u.start) & (v.start <= u.start), sees=(), folds={"n": A.tally()}, by=("k",))
    assert only(out, "x", "n") == [(0, 20_000, 20_000), (1, 20_000, 20_000), (2, 40_000, 20_000)]


def test_first_matches_of_points_that_are_alike(spark):
    o = same_parts(spark)
    out = o.join(o).on(K.dleq(1), names=("id",), by=("k",), first=4)
    assert only(out.select("x", F.col("matches.id").cast("string").alias("m")), "x", "m") == [(0, "[0, 1, 3, 4]", 20_000), (1, "[0, 1, 2, 3]", 20_000), (2, "[1, 2, 4, 5]", 20_000)]


def test_first_matches_repeat_and_may_be_none(spark):
    us = OrderedFrame(spark.createDataFrame([(1,), (9,), (None,)], "x int"), ("x",))
    vs = OrderedFrame(spark.createDataFrame([(2, "b"), (1, "c"), (1, "a"), (1, "a"), (8, None)], "x int, m string"), ("x",))
    got = {r.x: [m.m for m in r.matches] for r in us.join(vs).on(K.dleq(1), names=("m",), first=3).collect()}
    assert got == {1: ["a", "a", "b"], 9: [None], None: []}


def test_counts_of_intervals_that_are_alike(spark):
    rows = spark.range(60_000).select(F.lit("c").alias("chrom"), (F.col("id") % 3 * 10).cast("int").alias("start"), (F.col("id") % 3 * 10 + 12).cast("int").alias("end"), "id")
    count = lambda p: only(J.folded(rows, rows, p, folds={"n": A.tally()}), "start", "n")
    assert count(K.IS_BEFORE) == count(K.START_BEFORE) == [(0, 0, 20_000), (10, 20_000, 20_000), (20, 40_000, 20_000)]
    assert count(K.overlap(1)) == [(0, 40_000, 20_000), (10, 60_000, 20_000), (20, 40_000, 20_000)]
    assert count(K.near(8)) == [(x, 60_000, 20_000) for x in (0, 10, 20)]
