"""Predicates between a right row v and a left row u, as Columns with what a join needs to know.

``anti`` predicates may drive a join; the rest only screens. ``reach`` tells how far apart two
rows that fit may lie, or None if there is no bound: then bins can't serve the join. ``order`` and ``span``
say what a predicate means where running sums can stand for pairs, ``sees`` which columns it looks at besides places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Side:
    """The columns of one side of a join. A point is an interval whose ends are equal."""

    chrom: Column | None
    start: Column
    end: Column
    col: Callable[[str], Column] = F.col

    @property
    def size(self) -> Column:
        return self.end - self.start


@dataclass(frozen=True)
class Order:
    """The predicate holds just if v's place (of v's columns) comes before u's in order of numbers, or equals it if inclusive. Each is one column or two."""

    v: Callable[[Side], list[Column]]
    u: Callable[[Side], list[Column]]
    inclusive: bool = False


@dataclass(frozen=True)
class Span:
    """The predicate holds just if v starts no later than gap after u's end, ends no sooner than gap before u's start, and both are so long at least. gap: a number, or of each row u its own."""

    gap: float | Callable[[Side], Column]
    length: float | None = None


@dataclass(frozen=True)
class Pred:
    name: str
    test: Callable[[Side, Side], Column]
    anti: bool = False
    reach: float | None = None
    order: Order | None = None
    span: Span | None = None
    #: Columns besides the place (chrom, start, end) that the test looks at; None: any.
    sees: tuple[str, ...] | None = ()

    def __call__(self, v: Side, u: Side) -> Column:
        return self.test(v, u)

    def __and__(self, other: Pred) -> Pred:
        near = [r for r in (self.reach, other.reach) if r is not None]
        return Pred(f"({self.name} and {other.name})", lambda v, u: self(v, u) & other(v, u), self.anti or other.anti, min(near) if near else None, sees=_both(self, other))

    def __or__(self, other: Pred) -> Pred:
        far = [self.reach, other.reach]
        return Pred(f"({self.name} or {other.name})", lambda v, u: self(v, u) | other(v, u), self.anti and other.anti, None if None in far else max(far), sees=_both(self, other))

    def __invert__(self) -> Pred:
        return Pred(f"not {self.name}", lambda v, u: ~self(v, u), sees=self.sees)


def _both(a: Pred, b: Pred) -> tuple[str, ...] | None:
    return None if a.sees is None or b.sees is None else tuple(dict.fromkeys(a.sees + b.sees))


def requires(*preds: Pred) -> Pred:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def general(test: Callable[[Side, Side], Column], sees: tuple[str, ...] | None = None) -> Pred:
    return Pred("general", test, sees=sees)


def antimonotonic(test: Callable[[Side, Side], Column], reach: float | None = None, sees: tuple[str, ...] | None = None) -> Pred:
    return Pred("antimonotonic", test, True, reach, sees=sees)


# Points: numbers in order.


def _starts(sign: int = 1, inclusive: bool = False) -> Order:
    at = lambda s: [s.start * sign]
    return Order(at, at, inclusive)


def eq() -> Pred:
    return Pred("eq", lambda v, u: v.start == u.start, True, 0)


def lt() -> Pred:
    return Pred("lt", lambda v, u: v.start < u.start, True, order=_starts())


def lteq() -> Pred:
    return Pred("lteq", lambda v, u: v.start <= u.start, True, order=_starts(inclusive=True))


def gt() -> Pred:
    return Pred("gt", lambda v, u: v.start > u.start, order=_starts(-1))


def gteq() -> Pred:
    return Pred("gteq", lambda v, u: v.start >= u.start, order=_starts(-1, True))


def _apart(v: Side, u: Side, whole: bool) -> Column:
    d = F.abs(v.start - u.start)
    return F.floor(d) if whole else d


def dl(n: float, whole: bool = True) -> Pred:
    """Distance below n; whole: of doubles, the distance cut to a whole number."""
    return Pred(f"dl({n})", lambda v, u: _apart(v, u, whole) < n, True, n + 1)


def dleq(n: float, whole: bool = True) -> Pred:
    return Pred(f"dleq({n})", lambda v, u: _apart(v, u, whole) <= n, True, n + 1)


def dg(n: float, whole: bool = True) -> Pred:
    return Pred(f"dg({n})", lambda v, u: _apart(v, u, whole) > n)


def dgeq(n: float, whole: bool = True) -> Pred:
    return Pred(f"dgeq({n})", lambda v, u: _apart(v, u, whole) >= n)


def szpercent(x: float, size: Callable[[Column], Column] = lambda c: c) -> Pred:
    """Sizes at least 0 and the larger below x times the smaller. A number is its size; of strings, size is F.length."""
    return Pred(f"szpercent({x})", lambda v, u: (size(v.start) >= 0) & (size(u.start) >= 0) & (F.greatest(size(v.start), size(u.start)) < F.least(size(v.start), size(u.start)) * F.lit(float(x))), True)


# Intervals on a chromosome.


def _same(v: Side, u: Side) -> Column:
    return v.chrom == u.chrom if v.chrom is not None else F.lit(True)


def distance(v: Side, u: Side) -> Column:
    """Gap between two intervals of one chromosome, 0 if they overlap or touch; null between chromosomes."""
    return F.when(_same(v, u), F.greatest(v.start - u.end, u.start - v.end, F.lit(0)))


def shared(v: Side, u: Side) -> Column:
    return F.least(v.end, u.end) - F.greatest(v.start, u.start)


def is_before() -> Pred:
    return Pred("isBefore", lambda v, u: F.struct(v.chrom, v.start, v.end) < F.struct(u.chrom, u.start, u.end), True, order=Order(lambda s: [s.start, s.end], lambda s: [s.start, s.end]))


def same_chrom() -> Pred:
    return Pred("sameChrom", _same, True)


def same_locus() -> Pred:
    return Pred("sameLocus", lambda v, u: _same(v, u) & (v.start == u.start) & (v.end == u.end), True, 0)


def same_start() -> Pred:
    return Pred("sameStart", lambda v, u: _same(v, u) & (v.start == u.start), True, 0)


def same_end() -> Pred:
    return Pred("sameEnd", lambda v, u: _same(v, u) & (v.end == u.end), False, 0)


def start_before() -> Pred:
    return Pred("startBefore", lambda v, u: _same(v, u) & (v.start < u.start), True, order=_starts())


def start_after() -> Pred:
    return Pred("startAfter", lambda v, u: _same(v, u) & (v.start > u.end), order=Order(lambda s: [-s.start], lambda s: [-s.end]))


def end_before() -> Pred:
    return Pred("endBefore", lambda v, u: _same(v, u) & (v.end < u.start), order=Order(lambda s: [s.end], lambda s: [s.start]))


def end_after() -> Pred:
    return Pred("endAfter", lambda v, u: _same(v, u) & (v.end > u.end), order=Order(lambda s: [-s.end], lambda s: [-s.end]))


def overlap_start() -> Pred:
    return Pred("overlapStart", lambda v, u: _same(v, u) & (v.start <= u.start) & (u.start <= v.end), True, 0)


def overlap_end() -> Pred:
    return Pred("overlapEnd", lambda v, u: _same(v, u) & (v.start <= u.end) & (u.end <= v.end), False, 0)


def overlap(n: int = 1, strict: bool = True) -> Pred:
    """Share at least n; strict: touching isn't overlapping, even for n 0."""
    test = lambda v, u: _same(v, u) & (shared(v, u) >= n) & ((v.end > u.start) & (u.end > v.start) if strict else (v.end >= u.start) & (u.end >= v.start))
    return Pred(f"overlap({n})", test, True, 0, span=Span(-n, n) if n >= 1 else None if strict else Span(0, 0))


def near(n: int) -> Pred:
    return Pred(f"near({n})", lambda v, u: distance(v, u) <= n, True, n, span=Span(n))


def interval_dl(n: int) -> Pred:
    return Pred(f"dl({n})", lambda v, u: distance(v, u) < n, True, n)


def far(n: int = 1) -> Pred:
    return Pred(f"far({n})", lambda v, u: distance(v, u) >= n)


def inside() -> Pred:
    return Pred("inside", lambda v, u: _same(v, u) & (u.start <= v.start) & (v.end <= u.end), False, 0)


def enclose() -> Pred:
    return Pred("enclose", lambda v, u: _same(v, u) & (v.start <= u.start) & (u.end <= v.end), False, 0)


def touch() -> Pred:
    return Pred("touch", lambda v, u: _same(v, u) & ((v.end == u.start) | (u.end == v.start)), False, 0)


def outside() -> Pred:
    """Disjoint: another chromosome, or a gap between. Touching intervals aren't."""
    return Pred("outside", lambda v, u: ~_same(v, u) | (v.end < u.start) | (u.end < v.start))


def size_percent(x: float) -> Pred:
    return Pred(f"szpercent({x})", lambda v, u: F.greatest(v.size, u.size) < F.least(v.size, u.size) * F.lit(float(x)))


def compatible(a: Column, b: Column) -> Column:
    """Equal strands, or one is neither + nor -."""
    return (a == b) | ~a.isin("+", "-") | ~b.isin("+", "-")


def same_strand() -> Pred:
    return Pred("sameStrand", lambda v, u: _same(v, u) & compatible(v.col("strand"), u.col("strand")), sees=("strand",))


def plus_strand(strand: Column) -> Column:
    return strand != "-"


def minus_strand(strand: Column) -> Column:
    return strand != "+"


def between(lo: Pred, hi: Pred) -> Pred:
    return lo & hi


def based_on_start(pred: Pred) -> Pred:
    """pred between the starts alone."""
    at = lambda s: Side(s.chrom, s.start, s.start, s.col)
    return Pred(f"start {pred.name}", lambda v, u: pred(at(v), at(u)), pred.anti, pred.reach, sees=pred.sees)


def based_on_end(pred: Pred) -> Pred:
    """pred between the ends alone."""
    at = lambda s: Side(s.chrom, s.end, s.end, s.col)
    return Pred(f"end {pred.name}", lambda v, u: pred(at(v), at(u)), pred.anti, pred.reach, sees=pred.sees)


can_see = near
EQ, LT, LTEQ, GT, GTEQ = eq(), lt(), lteq(), gt(), gteq()
SAME_CHROM, SAME_LOCUS, SAME_START, SAME_END, IS_BEFORE = same_chrom(), same_locus(), same_start(), same_end(), is_before()
START_BEFORE, START_AFTER, END_BEFORE, END_AFTER, OVERLAP_START, OVERLAP_END = start_before(), start_after(), end_before(), end_after(), overlap_start(), overlap_end()
INSIDE, ENCLOSE, TOUCH, OUTSIDE = inside(), enclose(), touch(), outside()
