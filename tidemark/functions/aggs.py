"""Aggregates as values that are later put on the columns of some table.

``agg.on(c)`` gives the Column; c maps a name or Column to the Column meant. Empty groups give 0,
1 (product), 0.0 (average) or null (extremes), or with ``sentinel`` the type's own extreme.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = str | Column | Callable[[Callable[[str], Column]], Column]
Ref = Callable[[str], Column]


def resolve(x: Expr, c: Ref) -> Column:
    if callable(x) and not isinstance(x, Column):
        return x(c)
    return c(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Agg:
    build: Callable[[Ref], Column]

    def on(self, c: Ref = F.col) -> Column:
        return self.build(c)

    def over(self, window) -> Column:
        return self.build(F.col).over(window)

    def then(self, f: Callable[[Column], Column]) -> Agg:
        """Applies f to the result."""
        return Agg(lambda c: f(self.build(c)))

    def keep(self, where: Callable[[Ref], Column]) -> Agg:
        """Only rows where the condition holds."""
        return Agg(lambda c: self.build(lambda n: F.when(where(c), c(n))))


@dataclass(frozen=True)
class Fold:
    """An aggregate that is found from its values for parts of a group: kind is sum, min or max of the parts' values, empty what a group without rows has."""

    part: Agg
    kind: str
    empty: float | int | None = None

    def merge(self, c: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](c)


def tally() -> Fold:
    return Fold(count(), "sum", 0)


def summed(x: Expr) -> Fold:
    return Fold(Agg(lambda c: F.sum(resolve(x, c))), "sum", 0)


def least(x: Expr) -> Fold:
    return Fold(smallest(x), "min")


def most(x: Expr) -> Fold:
    return Fold(biggest(x), "max")


def combine(f: Agg, g: Agg, h: Callable[[Column, Column], Column]) -> Agg:
    return Agg(lambda c: h(f.on(c), g.on(c)))


def combine_n(h: Callable[..., Column], *fs: Agg) -> Agg:
    return Agg(lambda c: h(*(f.on(c) for f in fs)))


def several(**aggs: Agg) -> Agg:
    """A struct of several aggregates, found in one pass."""
    return Agg(lambda c: F.struct(*(a.on(c).alias(n) for n, a in aggs.items())))


def count(x: Expr | None = None) -> Agg:
    return Agg(lambda c: F.count(F.lit(1) if x is None else resolve(x, c)))


def total(x: Expr) -> Agg:
    return Agg(lambda c: F.coalesce(F.sum(resolve(x, c)), F.lit(0)))


def product(x: Expr) -> Agg:
    return Agg(lambda c: F.coalesce(F.product(resolve(x, c)), F.lit(1.0)))


def average(x: Expr) -> Agg:
    return Agg(lambda c: F.coalesce(F.avg(resolve(x, c)), F.lit(0.0)))


def smallest(x: Expr, sentinel: float | int | None = None) -> Agg:
    return Agg(lambda c: F.min(resolve(x, c)) if sentinel is None else F.coalesce(F.min(resolve(x, c)), F.lit(sentinel)))


def biggest(x: Expr, sentinel: float | int | None = None) -> Agg:
    return Agg(lambda c: F.max(resolve(x, c)) if sentinel is None else F.coalesce(F.max(resolve(x, c)), F.lit(sentinel)))


def collected(*names: str, order: str | None = None) -> Agg:
    """Rows as a sorted array of structs, of the named columns."""
    return Agg(lambda c: F.array_sort(F.collect_list(F.struct(*((c(order).alias("_order"),) if order else ()), *(c(n).alias(n) for n in names)))))


def _extreme(x: Expr, names: tuple[str, ...], best) -> Agg:
    """The extreme and all rows that attain it, for groups of matches: a group's rows are gathered, then filtered. Where groups may be large use OrderedFrame.extremes."""

    def build(c: Ref) -> Column:
        value = best(resolve(x, c))
        rows = F.collect_list(F.struct(resolve(x, c).alias("_value"), *(c(n).alias(n) for n in names)))
        kept = F.filter(rows, lambda r: r["_value"] == value)
        return F.struct(value.alias("value"), F.array_sort(F.transform(kept, lambda r: F.struct(*(r[n].alias(n) for n in names)))).alias("rows"))

    return Agg(build)


def minimize(x: Expr, *names: str) -> Agg:
    return _extreme(x, names, F.min)


def maximize(x: Expr, *names: str) -> Agg:
    return _extreme(x, names, F.max)


def stats(x: Expr) -> Agg:
    """count, sum, sumsq, min, max, average, variance (of a sample; 0 for one row or none)."""

    def build(c: Ref) -> Column:
        v = resolve(x, c)
        zero = lambda e: F.coalesce(e, F.lit(0.0))
        return F.struct(
            F.count(v).alias("count"), zero(F.sum(v.cast("double"))).alias("sum"), zero(F.sum(v.cast("double") * v)).alias("sumsq"), F.min(v).alias("min"), F.max(v).alias("max"),
            zero(F.avg(v)).alias("average"), F.when(F.count(v) > 1, F.var_samp(v)).otherwise(0.0).alias("variance"),
        )

    return Agg(build)


def forall(x: Expr) -> Agg:
    return Agg(lambda c: F.coalesce(F.bool_and(resolve(x, c)), F.lit(True)))


def exists(x: Expr) -> Agg:
    return Agg(lambda c: F.coalesce(F.bool_or(resolve(x, c)), F.lit(False)))


def mapped(x: Expr) -> Agg:
    return Agg(lambda c: F.array_sort(F.collect_list(resolve(x, c))))


def flattened(x: Expr) -> Agg:
    return Agg(lambda c: F.array_sort(F.flatten(F.collect_list(resolve(x, c)))))


def with_rows(agg: Agg, *names: str) -> Agg:
    return several(value=agg, rows=collected(*names))
