"""Collections in order of a key: a DataFrame beside the columns it is sorted by.

Nothing depends on how rows lie; the key says what order means where an operation needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import Agg, Fold, collected
from ..functions.predicates import Pred, Side, antimonotonic
from . import joins


@dataclass(frozen=True)
class OrderedFrame:
    df: DataFrame
    keys: tuple[str, ...]
    descending: bool = False

    def _order(self) -> list[Column]:
        return [F.desc(k) if self.descending else F.asc(k) for k in self.keys]

    def _with(self, df: DataFrame) -> OrderedFrame:
        return OrderedFrame(df, self.keys, self.descending)

    # Rows.

    def filter(self, where: Column | str) -> OrderedFrame:
        return self._with(self.df.where(where))

    def select(self, *cols: Column | str) -> OrderedFrame:
        return self._with(self.df.select(*cols))

    def extend(self, **exprs: Column) -> OrderedFrame:
        return self._with(self.df.withColumns(exprs))

    def explode(self, array: str, into: str) -> OrderedFrame:
        return self._with(self.df.withColumn(into, F.explode(array)))

    def take(self, n: int) -> DataFrame:
        return self.df.orderBy(*self._order()).limit(n)

    def drop(self, n: int) -> DataFrame:
        return self.df.orderBy(*self._order()).offset(n)

    def nth(self, n: int) -> DataFrame:
        """The row n, counted from 0."""
        return self.df.orderBy(*self._order()).offset(n).limit(1)

    def count(self) -> int:
        return self.df.count()

    # Order.

    def ordered_by(self, *keys: str, descending: bool = False) -> OrderedFrame:
        return OrderedFrame(self.df, keys, descending)

    assume_ordered_by = ordered_by

    def reversed(self) -> OrderedFrame:
        return OrderedFrame(self.df, self.keys, not self.descending)

    def rows(self) -> DataFrame:
        return self.df.orderBy(*self._order())

    def is_ordered(self, position: str) -> bool:
        """Whether the key doesn't fall in order of position (a number that says how rows lie)."""
        before, key = F.col("_left"), F.struct(*self.keys)
        ok = before.isNull() | ((key <= before) if self.descending else (before <= key))
        return bool(joins.neighbours(self.df.select(position, *(k for k in self.keys if k != position)), [], position, list(self.keys)).agg(F.coalesce(F.bool_and(ok), F.lit(True))).first()[0])

    def sorted_if_needed(self, position: str) -> OrderedFrame:
        """Itself where rows lie in order of the key already, else with rows in that order."""
        return self if self.is_ordered(position) else self._with(self.rows())

    def merged_with(self, *others: OrderedFrame) -> OrderedFrame:
        return self._with(reduce(lambda a, b: a.unionByName(b), [o.df for o in others], self.df))

    def same_rows(self, other: OrderedFrame) -> bool:
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()

    # Groups of equal keys.

    def clustered(self, *names: str, into: str = "rows") -> DataFrame:
        return self.df.groupBy(*self.keys).agg(collected(*names).on().alias(into))

    def runs(self, position: str, by: tuple[str, ...] = (), **aggs: Agg) -> DataFrame:
        """Aggregates of runs of equal keys as rows lie in order of position (in each of by)."""
        w = Window.partitionBy(*by).orderBy(position) if by else Window.orderBy(position)
        key = F.struct(*self.keys)
        own = self.df.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
        return own.groupBy(*by, "_run", *self.keys).agg(*(a.on().alias(n) for n, a in aggs.items())).drop("_run")

    def clustered_fold(self, **aggs: Agg) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*(a.on().alias(n) for n, a in aggs.items()))

    def extremes(self, x: str, *names: str, most: bool = False, into: str = "rows") -> DataFrame:
        """Of each key the least (most: the greatest) x as value, and the named columns of all rows that attain it. Only those rows are gathered."""
        best = (F.max if most else F.min)(x).alias("value")
        found = self.df.join(self.df.groupBy(*self.keys).agg(best), list(self.keys)).where(F.col(x) == F.col("value"))
        return found.groupBy(*self.keys, "value").agg(collected(*names).on().alias(into))

    def histogram(self, x: str, into: str = "histogram") -> DataFrame:
        """Of each key, how often each value of x occurs, as a map. Counted before it is gathered."""
        counts = self.df.where(F.col(x).isNotNull()).groupBy(*self.keys, x).agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*self.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "_n")))).alias(into))

    def distinct_keys(self) -> DataFrame:
        return self.df.select(*self.keys).distinct()

    def aggregated(self, **aggs: Agg) -> DataFrame:
        return self.df.agg(*(a.on().alias(n) for n, a in aggs.items()))

    # Neighbours in order.

    def sliding(self, n: int, *names: str, by: tuple[str, ...] = (), into: str = "window") -> OrderedFrame:
        """The n rows before a row and itself, as an array."""
        w = Window.partitionBy(*by).orderBy(*self._order()).rowsBetween(-n, 0)
        return self._with(self.df.withColumn(into, F.collect_list(F.struct(*names)).over(w)))

    def ahead(self, name: str, n: int = 1, by: tuple[str, ...] = (), into: str = "next") -> OrderedFrame:
        return self._with(self.df.withColumn(into, F.lead(name, n).over(Window.partitionBy(*by).orderBy(*self._order()))))

    # Joins with another collection by the key: one number or string, or the two ends of an interval.

    def join(self, other: OrderedFrame) -> Joined:
        if len(self.keys) != len(other.keys) or len(self.keys) > 2:
            raise ValueError("a join needs one key column on each side, or two")
        return Joined(self, other)


@dataclass(frozen=True)
class Joined:
    us: OrderedFrame
    vs: OrderedFrame

    def _sides(self, preds: tuple[Pred, ...], where: Callable[[], Column] | None, sees: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame, list[Pred], dict]:
        if not any(p.anti for p in preds):
            raise ValueError("one predicate at least must be antimonotonic")
        others = self.vs.df.withColumnsRenamed({v: u for u, v in zip(self.us.keys, self.vs.keys, strict=True) if u != v})
        screens = [Pred("where", lambda v, u: where(), sees=sees)] if where else []
        return self.us.df, others, [*preds, *screens], {"chrom": None, "start": self.us.keys[0], "end": self.us.keys[-1]}

    def on(self, *preds: Pred, names: tuple[str, ...], where: Callable[[], Column] | None = None, into: str = "matches", first: int | None = None, by: tuple[str, ...] = (), sees: tuple[str, ...] | None = None) -> DataFrame:
        """Each row of us with the sorted array of its matches (named columns of vs). One predicate must be antimonotonic.

        where screens pairs (vs' columns with prefix r_) by the columns sees (default: any); first keeps so many of the matches.
        """
        us, vs, every, how = self._sides(preds, where, sees)
        if first:
            return joins.first_matches(us, vs, *every, n=first, names=names, into=into, by=by, **how)
        return joins.matches(us, vs, *every, names=names, into=into, by=by, **how)

    def fold(self, *preds: Pred, where: Callable[[], Column] | None = None, by: tuple[str, ...] = (), sees: tuple[str, ...] | None = None, **folds: Fold) -> DataFrame:
        """Each row of us with folds of its matches, which are never gathered."""
        us, vs, every, how = self._sides(preds, where, sees)
        return joins.folded(us, vs, *every, folds=folds, by=by, **how)

    def using(self, test: Callable[[Side, Side], Column], names: tuple[str, ...] = (), reach: float | None = None, sees: tuple[str, ...] | None = None, folds: dict[str, Fold] | None = None, **how) -> DataFrame:
        """The same by any function of a right and a left row, with matches or folds of them. reach: how far apart rows that fit may lie, if there is a bound; sees: what it looks at besides keys (default: any)."""
        pred = antimonotonic(test, reach, sees)
        return self.fold(pred, **folds, **how) if folds else self.on(pred, names=names, **how)
