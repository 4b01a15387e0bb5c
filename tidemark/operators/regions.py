"""Operations on interval tables: chrom, start, end, name, score, strand and further columns.

``by`` names columns (a sample's sid) that must agree besides; all operations run on many samples at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import Agg, count
from ..functions.predicates import Pred, overlap, same_locus, same_strand
from . import joins

FIXED = ["chrom", "start", "end", "name", "score", "strand"]
By = tuple[str, ...]


def misc(df: DataFrame, by: By = ()) -> list[str]:
    return [c for c in df.columns if c not in FIXED and c not in by]


# Rows.


def select_r(df: DataFrame, where: Column | str) -> DataFrame:
    return df.where(where)


def project_r(df: DataFrame, by: By = (), **exprs: Column) -> DataFrame:
    """The fixed columns and exprs alone. An expr with a fixed column's name hides it."""
    return df.select(*by, *(c for c in FIXED if c not in exprs), *(e.alias(n) for n, e in exprs.items()))


def extend_r(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def shift(df: DataFrame, n: int) -> DataFrame:
    return df.withColumns({"start": F.col("start") + n, "end": F.col("end") + n})


def chrom_start(df: DataFrame) -> DataFrame:
    return df.withColumn("end", F.col("start"))


def chrom_end(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("end"))


def union_r(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# Groups by locus.


def partition_r(df: DataFrame, by: By = (), group: Column | None = None, **aggs: Agg) -> DataFrame:
    """A row a locus (and group), with aggregates; name is empty, score 0, strand a dot."""
    keys = [*by, "chrom", "start", "end"]
    extra = [group.alias("group")] if group is not None else []
    out = df.groupBy(*keys, *extra).agg(*(a.on().alias(n) for n, a in aggs.items())) if aggs else df.select(*keys, *extra).distinct()
    return out.select(*keys, F.lit("").alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), *(["group"] if extra else []), *aggs)


# Map and difference.


def map_r(us: DataFrame, vs: DataFrame, by: By = (), counter: str = "count", width: int | None = None, **aggs: Agg) -> DataFrame:
    """Each row of us, the number of rows of vs that overlap it on a compatible strand, and aggregates of them."""
    return joins.grouped(us, vs, overlap(1), same_strand(), aggs={counter: count("_hit"), **aggs}, by=by, width=width)


def difference_r(us: DataFrame, *others: DataFrame, by: By = (), exact: bool = False, width: int | None = None) -> DataFrame:
    """Rows of us that no row of others overlaps on a compatible strand (exact: and has the same locus)."""
    if not others:
        return us
    keys = [*by, "chrom", "start", "end", "strand"]
    vs = union_r(*(o.select(*keys) for o in others))
    if exact:
        v = joins.prefixed(vs)
        u, w = joins.side(), joins.side(joins.RIGHT)
        cond = same_locus()(w, u) & overlap(1)(w, u) & same_strand()(w, u)
        for k in by:
            cond = cond & (F.col(k) == F.col(joins.RIGHT + k))
        return us.join(v, cond, "left_anti")
    return joins.without(us, vs, overlap(1), same_strand(), by=by, width=width)


# Outputs of joins: from a row of us and one with prefix r_.

Output = Callable[[list[str], list[str], list[str]], tuple[list[Column], Column | None]]
_R = joins.RIGHT


def left(fixed: list[str], u_misc: list[str], v_misc: list[str]) -> tuple[list[Column], Column | None]:
    return [F.col(c) for c in (*fixed, *u_misc)], None


def right(fixed: list[str], u_misc: list[str], v_misc: list[str]) -> tuple[list[Column], Column | None]:
    return [F.col(_R + c).alias(c) for c in (*fixed, *v_misc)], None


def _moved(start: Column, end: Column, fixed: list[str]) -> list[Column]:
    return [start.alias("start") if c == "start" else end.alias("end") if c == "end" else F.col(c) for c in fixed]


def intersection(rename: Callable[[str], str] = lambda n: _R + n) -> Output:
    def out(fixed, u_misc, v_misc):
        start, end = F.greatest("start", _R + "start"), F.least("end", _R + "end")
        return [*_moved(start, end, fixed), *map(F.col, u_misc), *(F.col(_R + c).alias(rename(c)) for c in v_misc)], (F.col("chrom") == F.col(_R + "chrom")) & (start <= end)

    return out


def both(rename: Callable[[str], str] = lambda n: _R + n) -> Output:
    def out(fixed, u_misc, v_misc):
        return [*map(F.col, (*fixed, *u_misc)), *(F.col(_R + c).alias(rename(c)) for c in (*v_misc, "chrom", "start", "end"))], None

    return out


def hull(rename: Callable[[str], str] = lambda n: _R + n) -> Output:
    def out(fixed, u_misc, v_misc):
        return [*_moved(F.least("start", _R + "start"), F.greatest("end", _R + "end"), fixed), *map(F.col, u_misc), *(F.col(_R + c).alias(rename(c)) for c in v_misc)], None

    return out


# Orderings of results.


def sort(df: DataFrame, by: By = ()) -> DataFrame:
    return df.orderBy(*by, "chrom", "start", "end")


def distinct(df: DataFrame, position: str | None = None) -> DataFrame:
    """Without whole rows that repeat; with a position (a number that says how rows lie), without those that repeat the row before in all other columns."""
    if position is None:
        return df.distinct()
    names = [c for c in df.columns if c != position]
    return joins.neighbours(df, [], position, names).where(~F.struct(*names).eqNullSafe(F.col("_left"))).drop("_left", "_right")


def sort_distinct(df: DataFrame, by: By = ()) -> DataFrame:
    return sort(df.distinct(), by)


def plus(df: DataFrame) -> DataFrame:
    return df.where("strand <> '-'").withColumn("strand", F.lit("+")).distinct()


def minus(df: DataFrame) -> DataFrame:
    return df.where("strand <> '+'").withColumn("strand", F.lit("-")).distinct()


def null_strand(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", F.lit("."))


def none(df: DataFrame) -> DataFrame:
    return df


# Joins.


def _put(joined: DataFrame, us: DataFrame, vs: DataFrame, by: By, output: Output, ordering: Callable[[DataFrame], DataFrame]) -> DataFrame:
    cols, cond = output([*by, *FIXED], misc(us, by), misc(vs, by))
    joined = joined.where(cond) if cond is not None else joined
    return ordering(joined.select(*cols))


def join_r(us: DataFrame, vs: DataFrame, *preds: Pred, by: By = (), output: Output | None = None, ordering: Callable[[DataFrame], DataFrame] = none, width: int | None = None) -> DataFrame:
    """Pairs on compatible strands that fit all preds, as output makes them."""
    if not any(p.anti for p in preds):
        raise ValueError("one predicate at least must be antimonotonic")
    return _put(joins.pairs(us, vs, *preds, same_strand(), by=by, width=width), us, vs, by, output or both(), ordering)


def inner_nearest_r(us: DataFrame, vs: DataFrame, *preds: Pred, n: int = 1, by: By = (), ties: bool = False, include_overlap: bool = False, output: Output | None = None, ordering: Callable[[DataFrame], DataFrame] = none) -> DataFrame:
    """Of the pairs that fit all preds, the n nearest of each row of us."""
    return _put(joins.closest(us, vs, *preds, n=n, by=by, ties=ties, include_overlap=include_overlap), us, vs, by, output or both(), ordering)


def outer_nearest_r(us: DataFrame, vs: DataFrame, drive: Pred, *screens: Pred, n: int = 1, by: By = (), ties: bool = False, include_overlap: bool = False, output: Output | None = None, ordering: Callable[[DataFrame], DataFrame] = none) -> DataFrame:
    """The n nearest of each row of us among those that fit drive; of them, those that fit screens."""
    found = joins.closest(us, vs, drive, n=n, by=by, ties=ties, include_overlap=include_overlap)
    for s in screens:
        found = found.where(s(joins.side(joins.RIGHT), joins.side()))
    return _put(found, us, vs, by, output or both(), ordering)


def nearest_r(us: DataFrame, vs: DataFrame, n: int = 1, by: By = (), output: Output | None = None, how: Callable = joins.nearest) -> DataFrame:
    """The n nearest on the whole chromosome; how: joins.nearest, joins.upstream or joins.downstream."""
    return _put(how(us, vs, n, by), us, vs, by, output or both(), none)
