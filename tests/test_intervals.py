"""Predicates, nearest rows and coverage against plain loops, on rows that have every awkward case; one test a rule that is easily got wrong."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggs as A
from tidemark.functions import predicates as K
from tidemark.operators import coverage as C
from tidemark.operators import joins as J
from tidemark.operators import regions as R
from tidemark.operators.ordered import OrderedFrame
from tidemark.operators.samples import Dataset

# touching, nested, identical, of no width, another chromosome, all strands, ties, chr10 before chr2
LOCI = [("chr2", 0, 10), ("chr2", 10, 20), ("chr2", 5, 5), ("chr2", 2, 8), ("chr2", 2, 8), ("chr10", 0, 10), ("chr2", 300, 900), ("chr2", 30, 35), ("chr2", 24, 26), ("chr2", 0, 0), ("chr10", 10, 10), ("chr2", 20, 24)]
ROWS = [(c, s, e, f"n{i}", i, "+-."[(i + i // 3) % 3], i) for i, (c, s, e) in enumerate(LOCI)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "chrom string, start int, end int, name string, score int, strand string, id int").cache()


def gap(v, u):
    return max(v[1] - u[2], u[1] - v[2], 0) if v[0] == u[0] else None


def same(v, u):
    return v[0] == u[0]


CASES = {
    "overlap1": (K.overlap(1), lambda v, u: same(v, u) and v[2] > u[1] and u[2] > v[1] and min(v[2], u[2]) - max(v[1], u[1]) >= 1),
    "overlap0": (K.overlap(0), lambda v, u: same(v, u) and v[2] > u[1] and u[2] > v[1]),
    "overlap0 inclusive": (K.overlap(0, strict=False), lambda v, u: same(v, u) and v[2] >= u[1] and u[2] >= v[1]),
    "overlap4": (K.overlap(4), lambda v, u: same(v, u) and v[2] > u[1] and u[2] > v[1] and min(v[2], u[2]) - max(v[1], u[1]) >= 4),
    "near": (K.near(6), lambda v, u: same(v, u) and gap(v, u) <= 6),
    "dl": (K.interval_dl(6), lambda v, u: same(v, u) and gap(v, u) < 6),
    "far": (K.near(500) & K.far(7), lambda v, u: same(v, u) and 7 <= gap(v, u) <= 500),
    "far alone": (K.far(7), lambda v, u: same(v, u) and gap(v, u) >= 7),
    "same locus": (K.same_locus(), lambda v, u: v[:3] == u[:3]),
    "same start": (K.same_start(), lambda v, u: v[:2] == u[:2]),
    "same end": (K.same_end(), lambda v, u: same(v, u) and v[2] == u[2]),
    "start before": (K.start_before(), lambda v, u: same(v, u) and v[1] < u[1]),
    "start after": (K.start_after(), lambda v, u: same(v, u) and v[1] > u[2]),
    "end before": (K.end_before(), lambda v, u: same(v, u) and v[2] < u[1]),
    "end after": (K.end_after(), lambda v, u: same(v, u) and v[2] > u[2]),
    "overlap start": (K.overlap_start(), lambda v, u: same(v, u) and v[1] <= u[1] <= v[2]),
    "overlap end": (K.overlap_end(), lambda v, u: same(v, u) and v[1] <= u[2] <= v[2]),
    "inside": (K.inside(), lambda v, u: same(v, u) and u[1] <= v[1] and v[2] <= u[2]),
    "enclose": (K.enclose(), lambda v, u: same(v, u) and v[1] <= u[1] and u[2] <= v[2]),
    "touch": (K.touch(), lambda v, u: same(v, u) and (v[2] == u[1] or u[2] == v[1])),
    "size": (K.near(20) & K.size_percent(1.5), lambda v, u: same(v, u) and gap(v, u) <= 20 and max(v[2] - v[1], u[2] - u[1]) < 1.5 * min(v[2] - v[1], u[2] - u[1])),
    "same strand": (K.near(0) & K.same_strand(), lambda v, u: same(v, u) and gap(v, u) == 0 and (v[5] == u[5] or "." in (v[5], u[5]))),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("width", [64, 7])
def test_predicate(df, name, width):
    pred, test = CASES[name]
    got = sorted((r.id, r.r_id) for r in J.pairs(df, df, pred, width=width).select("id", "r_id").collect())
    assert got == sorted((u[6], v[6]) for u in ROWS for v in ROWS if same(v, u) and test(v, u))


def test_other_chromosome_is_outside_and_has_no_distance(spark):
    df = spark.createDataFrame([("a", 0, 5, "b", 0, 5), ("a", 0, 5, "a", 5, 6), ("a", 0, 5, "a", 6, 7)], "chrom string, start int, end int, r_chrom string, r_start int, r_end int")
    u, v = J.side(), J.side("r_")
    assert [tuple(r) for r in df.select(K.outside()(v, u), K.distance(v, u), (K.is_before())(u, v)).collect()] == [(True, None, True), (False, 0, True), (True, 1, True)]


def test_all_nine_strand_pairs(spark):
    pairs = list(itertools.product("+-.", repeat=2))
    got = spark.createDataFrame(pairs, "a string, b string").select(K.compatible(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [a == b or "." in (a, b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nearest_is_brute_force(df, n):
    fit = lambda v, u: same(v, u) and (v[5] == u[5] or "." in (v[5], u[5]))
    near, up, down = set(), set(), set()
    for u in ROWS:
        beside = sorted((v for v in ROWS if fit(v, u) and (v[2] < u[1] or v[1] > u[2])), key=lambda v: (gap(v, u), *v[1:]))
        near |= {(u[6], v[6]) for v in beside[:n]}
        up |= {(u[6], v[6]) for v in sorted((v for v in beside if v[2] < u[1]), key=lambda v: v[1:])[-n:]}
        down |= {(u[6], v[6]) for v in sorted((v for v in beside if v[1] > u[2]), key=lambda v: v[1:])[:n]}
    ids = lambda out: {(r.id, r.r_id) for r in out.collect()}
    assert ids(J.nearest(df, df, n)) == near and ids(J.upstream(df, df, n)) == up and ids(J.downstream(df, df, n)) == down


def test_map_and_difference_keep_every_row(df):
    got = R.map_r(df, df.where("id < 0"), total=A.total("score"), mean=A.average("score"), least=A.smallest("score", 2**31 - 1)).collect()
    assert len(got) == len(ROWS) and all((r["count"], r.total, r.mean, r.least) == (0, 0, 0.0, 2**31 - 1) for r in got)
    joined = R.join_r(df, df, K.overlap(1), output=R.left).count()
    assert sum(r["count"] for r in R.map_r(df, df).collect()) == joined
    kept = R.difference_r(df, df).collect()
    assert {r.id for r in kept} == {r[6] for r in ROWS if not any(CASES["overlap1"][1](v, r) and (v[5] == r[5] or "." in (v[5], r[5])) for v in ROWS)}
    assert R.difference_r(df).count() == len(ROWS)


def test_zero_width_loci_stay_in_an_exact_difference(df):
    assert {2, 9, 10} <= {r.id for r in R.difference_r(df, df, exact=True).collect()}


def test_touching_stretches_merge(spark):
    rows = [("c", a, b, "", 0, "+") for a, b in ((0, 10), (5, 20), (12, 18), (30, 40))]
    df = spark.createDataFrame(rows, "chrom string, start int, end int, name string, score int, strand string")
    loci = lambda out: sorted((r.start, r.end) for r in out.collect())
    one = C.at_least(1)
    assert loci(C.cover(df, one)) == [(0, 20), (30, 40)] and loci(C.summit(df, one)) == [(5, 10), (12, 18), (30, 40)]
    assert loci(C.flat(df, one)) == [(0, 20), (30, 40)] and loci(C.complement(df)) == [(20, 30)]
    assert sum((r.end - r.start) * r.htIndex for r in C.histo(df, one).collect()) == sum(b - a for _, a, b, *_ in rows)
    assert loci(C.histo(df, C.exactly(2))) == [(5, 10), (12, 18)] and C.histo(df.where("start < 0"), one).count() == 0


def test_depth_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(J, "STRETCH", 4)
    rows = [("c", 0, 100, "", 0, "+"), ("c", 3, 4, "", 0, "."), ("c", 50, 51, "", 0, "-")]
    df = spark.createDataFrame(rows, "chrom string, start int, end int, name string, score int, strand string")
    got = sorted((r.strand, r.start, r.end, r.htIndex) for r in C.depths(df).collect())
    assert got == [("+", 0, 3, 1), ("+", 3, 4, 2), ("+", 4, 100, 1), ("-", 3, 4, 1), ("-", 50, 51, 1)]


def test_distance_joins_of_a_sorted_list(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9]
    o = OrderedFrame(spark.createDataFrame([(v,) for v in values], "v int"), ("v",))
    got = sorted((r.v, [m.v for m in r.matches]) for r in o.join(o).on(K.dl(2), names=("v",)).collect())
    assert got == sorted((v, sorted(w for w in values if abs(v - w) < 2)) for v in values)
    got = sorted((r.v, [m.v for m in r.matches]) for r in o.join(o).on(K.lteq(), K.dg(3), names=("v",)).collect())
    assert got == sorted((v, sorted(w for w in values if w <= v and abs(v - w) > 3)) for v in values)
    with pytest.raises(ValueError):
        o.join(o).on(K.gt(), names=("v",))
    assert o.same_rows(o.reversed()) and [r.v for r in o.reversed().take(2).collect()] == [9, 8] and o.nth(3).first().v == 4 and o.drop(9).count() == 2


def test_rows_that_repeat_stay_apart(spark):
    us = spark.createDataFrame([("c", 0, 10, "+", 1)] * 3 + [("c", 50, 60, "+", 2)] * 2, "chrom string, start int, end int, strand string, id int")
    vs = spark.createDataFrame([("c", 5, 6, "+"), ("c", 7, 8, "+"), ("c", 20, 21, "+")], "chrom string, start int, end int, strand string")
    assert sorted((r.id, r["count"]) for r in R.map_r(us, vs).collect()) == [(1, 2)] * 3 + [(2, 0)] * 2
    assert sorted(r.id for r in R.difference_r(us, vs).collect()) == [2, 2]
    assert sorted((r.id, r.r_start) for r in J.upstream(us, vs, 2).collect()) == [(2, 7)] * 2 + [(2, 20)] * 2
    assert sorted((r.id, r.r_start) for r in J.nearest(us, vs, 1).collect()) == [(1, 20)] * 3 + [(2, 20)] * 2


def test_groups_with_missing_keys_stay_apart(spark):
    s = spark.createDataFrame([("a", None, "x"), ("b", "x", None), ("c", "x|y", "z"), ("d", "x", "y|z"), ("e", "x", None)], "sid string, k string, l string")
    rows = spark.createDataFrame([(n, "c", 0, 5, "", 0, "+") for n in "abcde"], "sid string, chrom string, start int, end int, name string, score int, strand string")
    out = Dataset(s, rows).cover_s(lambda df, by: C.histo(df, C.at_least(1), by), "k", "l")
    depth = {(r.k, r.l): r.htIndex for r in out.samples.join(out.regions, "sid").collect()}
    assert depth == {(None, "x"): 1, ("x", None): 2, ("x|y", "z"): 1, ("x", "y|z"): 1}


def test_consecutive_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(J, "STRETCH", 2)
    df = spark.createDataFrame(list(enumerate("aabbbaac")), "at int, x string")
    assert [r.x for r in R.distinct(df, "at").orderBy("at").collect()] == list("abac")
    o = OrderedFrame(df, ("x",))
    assert not o.is_ordered("at") and OrderedFrame(df, ("at",)).is_ordered("at") and not OrderedFrame(df, ("at",), True).is_ordered("at")
    assert [(r.value, r["rows"][0].x) for r in o.extremes("at", "x").orderBy("x").collect()] == [(0, "a"), (2, "b"), (7, "c")]
    assert {r.x: r.histogram for r in OrderedFrame(df.withColumn("y", df["at"] % 2), ("x",)).histogram("y").collect()} == {"a": {0: 2, 1: 2}, "b": {0: 2, 1: 1}, "c": {1: 1}}


def test_semijoin_with_missing_values(spark):
    s = spark.createDataFrame([("a", "x", "p"), ("b", None, "p"), ("c", "x", None), ("d", "x", "q")], "sid string, cell string, tf string")
    ds = Dataset(s, spark.createDataFrame([], "sid string, chrom string, start int, end int, name string, score int, strand string"))
    assert sorted(r.sid for r in ds.semijoin(ds, ("cell",), ("tf",)).samples.collect()) == ["a", "c", "d"]  # c meets itself: missing on the other side differs


def test_stats_of_one_and_none(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    one = df.agg(A.stats("x").on().alias("s")).first().s
    assert tuple(one) == (1, 1.5, 2.25, 1.5, 1.5, 1.5, 0.0)
    none = df.where("x < 0").agg(A.stats("x").on().alias("s"), A.product("x").on().alias("p"), A.forall(F.col("x") > 9).on().alias("f")).first()
    assert tuple(none.s) == (0, 0.0, 0.0, None, None, 0.0, 0.0) and none.p == 1.0 and none.f
