"""Nearest rows within reach, extremes of matches and pairs at landmarks against plain loops, and on rows that are alike."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggs as A
from tidemark.functions import predicates as K
from tidemark.operators import joins as J

from .test_intervals import CASES, ROWS, df, gap, same  # noqa: F401

SCORE = K.general(lambda v, u: v.col("score") > u.col("score"), sees=("score",))


@pytest.mark.parametrize("n, ties, overlap, screened", [(1, False, False, False), (1, False, False, True), (2, False, False, False), (2, True, True, False), (3, True, False, False), (2, True, True, True), (2, False, True, True)])
def test_closest(df, n, ties, overlap, screened):  # noqa: F811
    want = []
    for u in ROWS:
        fit = [v for v in ROWS if same(v, u) and (v[5] == u[5] or "." in (v[5], u[5])) and gap(v, u) <= 20 and (not screened or v[4] > u[4])]
        fit = sorted((gap(v, u), *v[1:5], v[5], v[6]) for v in fit if overlap or v[2] < u[1] or v[1] > u[2])
        want += [(u[6], v[-1]) for i, v in enumerate(fit) if (sum(w[0] < v[0] for w in fit) if ties else i) < n]
    preds = [K.near(20), *([SCORE] if screened else [])]
    got = J.closest(df, df, *preds, n=n, ties=ties, include_overlap=overlap)
    assert sorted((r.id, r.r_id) for r in got.select("id", "r_id").collect()) == sorted(want)


def test_extremes(df):  # noqa: F811
    want = []
    for u in ROWS:
        ids = [v[6] for v in ROWS if CASES["near"][1](v, u)]
        want.append((u[6], min(i // 3 for i in ids), sum(i // 3 == min(ids) // 3 for i in ids)))
    rows = df.withColumn("s", F.floor(F.col("id") / 3))
    got = J.extremes(rows, rows, K.near(6), x="s", folds={"n": A.tally()}).collect()
    assert sorted((r.id, r.value, r.n) for r in got) == sorted(want)


@pytest.mark.parametrize("pred, test", [(K.based_on_start(K.near(4)), lambda a, b: abs(a[1] - b[1]) <= 4), (K.START_BEFORE, lambda a, b: b[1] < a[1]), (K.near(0), lambda a, b: gap(b, a) == 0)])
def test_pairs_at_landmarks(df, pred, test):  # noqa: F811
    near = lambda a, b: same(a, b) and gap(a, b) <= 3
    want = [(m[6], a[6], b[6]) for m in ROWS for a in ROWS for b in ROWS if near(m, a) and near(m, b) and test(a, b) and a[6] < b[6]]
    got = J.landmark_pairs(df, df, df, K.near(3), pred, key=("id",), where=F.col("u_id") < F.col("v_id"))
    assert sorted((r.id, r.u_id, r.v_id) for r in got.collect()) == sorted(want)


def test_rows_that_are_alike(spark):
    """So many that all pairs would be 900 millions."""
    rows = spark.range(60_000).select(F.lit("c").alias("chrom"), (F.col("id") % 2 * 50).cast("int").alias("start"), (F.col("id") % 2 * 50 + 10).cast("int").alias("end"), F.lit("+").alias("strand"), (F.col("id") % 4).alias("score"), "id")
    us, vs = rows.where("start = 0"), rows.where("start = 50 or id = 0")
    got = J.extremes(rows, us, K.overlap(1), x="score", folds={"n": A.tally(), "first": A.least("id")})
    assert {(r.value, r.n, r.first) for r in got.distinct().collect()} >= {(0, 15_000, 0)} and got.count() == 30_000
    limits = J._reached(us.select("chrom", "start", "end", "strand").distinct(), vs.groupBy("chrom", "start", "end", "strand").agg(F.count("id").alias("_m")), 1, [K.near(80), J._APART], (), 64)
    assert [r._t for r in limits.collect()] == [40]
    assert [r._t for r in J._reached_by_rank(us.select("chrom", "start", "end", "strand").distinct(), vs, 2, (), True).collect()] == [40]
