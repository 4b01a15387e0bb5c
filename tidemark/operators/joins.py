"""Joins on order and place: bins where matches are near, ranks where only neighbours count.

Catalyst takes equalities out of a join condition but not ranges. A bounded predicate is
turned into an equality on bins: each row is filed under the bins that it lies in (the left side widened
by the predicate's reach) and a pair counts in one of its common bins only, so no
distinct is needed. Nearest neighbours without a bound are found by rank: a left row counts
the right rows before it, and its neighbours are those of the ranks next to that count, again equalities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import Fold, least, most, tally
from ..functions.predicates import Order, Pred, Side, Span, distance, requires, same_strand
from ..session import cut_lineage

LEFT, RIGHT = "", "r_"
#: Bins of intervals are powers of two between these. At twice the mean length or more, all rows together lie in three bins a row at most, whatever the longest is.
LEAST_WIDTH, MOST_WIDTH = 64, 1 << 40
#: Positions are counted in stretches of this length, so a chromosome is many tasks.
STRETCH = 1 << 16


def prefixed(df: DataFrame, prefix: str = RIGHT) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))


def side(prefix: str = LEFT, chrom: str | None = "chrom", start: str = "start", end: str = "end") -> Side:
    col = lambda n: F.col(prefix + n)
    return Side(col(chrom) if chrom else None, col(start), col(end), col)


def bin_width(us: DataFrame, vs: DataFrame, start: str = "start", end: str = "end", reach: float = 0) -> int:
    """A power of two of twice the mean length and reach at least, in one pass over both tables' two columns. Points have no length."""
    mean, width = 0.0, 1
    if start != end:
        width = LEAST_WIDTH
        mean = us.select((F.col(end) - F.col(start)).alias("n")).union(vs.select((F.col(end) - F.col(start)).alias("n"))).agg(F.avg("n")).first()[0] or 0.0
    while width < MOST_WIDTH and width < 2 * (float(mean) + float(reach)):
        width *= 2
    return width


def _bins(lo: Column, hi: Column, width: int) -> Column:
    at = lambda x: F.floor(x / width).cast("long")
    return F.explode(F.sequence(at(lo), F.greatest(at(lo), at(hi))))


def pairs(us: DataFrame, vs: DataFrame, *preds: Pred, by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end", how: str = "inner", width: int | None = None, reach: Column | None = None) -> DataFrame:
    """us' columns and vs' with prefix r_, of pairs that fit all preds and agree in by (and chrom).

    how left: a row of us without a match is there once for each of its bins, with nulls;
    group by it. Unbounded predicates make a join on by and chrom with a range screen. reach: of each row of us its own, where one is known.
    """
    pred = requires(*preds)
    u, v = side(LEFT, chrom, start, end), side(RIGHT, chrom, start, end)
    keys = [*by, *((chrom,) if chrom else ())]
    cond = pred(v, u)
    for k in keys:
        cond = cond & (F.col(k) == F.col(RIGHT + k))
    right = prefixed(vs)
    if pred.reach is None:
        return us.join(right, cond, how)
    if start == end and pred.reach == 0:  # points without a distance between them are equal
        return us.join(right, cond & (u.start == v.start), how)
    width, reach = width or bin_width(us, vs, start, end, pred.reach), F.lit(pred.reach) if reach is None else reach
    left = us.withColumn("_bin", _bins(u.start - reach, u.end + reach, width))
    right = right.withColumn("r__bin", _bins(v.start, v.end, width))
    once = F.col("_bin") == F.floor(F.greatest(u.start - reach, v.start) / width)
    return left.join(right, cond & (F.col("_bin") == F.col("r__bin")) & once, how).drop("_bin", "r__bin")


def counted(us: DataFrame) -> DataFrame:
    """Each distinct row of us once, and _copies. Rows are named by what they hold, so a stage that is run again names them alike."""
    return us.groupBy(*us.columns).agg(F.count(F.lit(1)).alias("_copies"))


def repeated(df: DataFrame) -> DataFrame:
    """Each row _copies times."""
    return df.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")


def grouped(us: DataFrame, vs: DataFrame, *preds: Pred, aggs: dict, by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end", width: int | None = None, having: Column | None = None) -> DataFrame:
    """Each row of us (repeats apart) with aggregates of its matches; rows without a match stay. aggs: name -> Agg over vs' columns.

    Aggregates see nulls where there is no match: to count matches, count the column _hit.
    """
    marked = vs.withColumn("_hit", F.lit(1))
    joined = pairs(counted(us), marked, *preds, by=by, chrom=chrom, start=start, end=end, how="left", width=width)
    c = lambda n: F.col(RIGHT + n)
    cols = [a.on(c) for a in aggs.values()]
    out = joined.groupBy("_copies", *us.columns).agg(*(x.alias(n) for n, x in zip(aggs, cols, strict=True)))
    out = out.where(having) if having is not None else out
    return repeated(out).select(*us.columns, *aggs)


def _seen(df: DataFrame, pred: Pred, *places: str) -> list[str]:
    """The columns of df that pred looks at."""
    return list(dict.fromkeys((*places, *(c for c in df.columns if pred.sees is None or c in pred.sees))))


def _with(us: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """us left-joined to a row for each distinct value of on, nulls too."""
    found, same = found.withColumnsRenamed({c: "_at_" + c for c in on}), F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col("_at_" + c))
    return us.join(found, same, "left").drop(*("_at_" + c for c in on))


def _before(points: DataFrame, parts: DataFrame, keys: list[str], order: Order, folds: dict[str, Fold], u: Side, v: Side) -> DataFrame:
    """points with folds _f_name of the parts that come before it: running folds over both in one order."""
    place = lambda cols: (cols[0].alias("_pos"), (cols[1] if len(cols) > 1 else F.lit(0)).alias("_then"))
    types = {f.name: f.dataType for f in parts.schema}
    u_type = points.select(F.struct(*points.columns)).schema[0].dataType
    left = points.select(*keys, *place(order.u(u)), F.lit(int(order.inclusive)).alias("_kind"), F.struct(*points.columns).alias("_u"), *(F.lit(None).cast(types[f"_p_{n}"]).alias(f"_p_{n}") for n in folds))
    right = parts.select(*keys, *place(order.v(v)), F.lit(int(not order.inclusive)).alias("_kind"), F.lit(None).cast(u_type).alias("_u"), *(f"_p_{n}" for n in folds))
    every = left.union(right).where("_pos is not null")
    for kind in dict.fromkeys(f.kind for f in folds.values()):
        every = running(every, keys, "_pos", ["_then", "_kind"], {f"_f_{n}": F.col(f"_p_{n}") for n, f in folds.items() if f.kind == kind}, kind=kind)
    return every.where("_u is not null").select("_u.*", *(f"_f_{n}" for n in folds))


def folded(us: DataFrame, vs: DataFrame, *preds: Pred, folds: dict[str, Fold], by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of us (repeats too) with folds of its matches; rows without a match stay. No interval may end before it starts.

    Rows that are alike in all that the predicates see are taken together before they are compared, so pairs grow with
    the distinct values. Where the predicate is an order, running folds take the place of pairs; sums over a span are the difference of two.
    """
    pred, keys = requires(*preds), [*by, *((chrom,) if chrom else ())]
    on, of = (_seen(df, pred, *keys, start, end) for df in (us, vs))
    points, parts = us.select(*on).distinct(), vs.groupBy(*of).agg(*(f.part.on().alias(f"_p_{n}") for n, f in folds.items()))
    s, span = side(LEFT, chrom, start, end), pred.span
    if pred.order:
        found = _before(points, parts, keys, pred.order, folds, s, s)
    elif span and all(f.kind == "sum" for f in folds.values()):
        if span.length is not None:
            points, parts = points.where(s.size >= span.length), parts.where(s.size >= span.length)
        gap = span.gap if callable(span.gap) else lambda u: span.gap
        started = Order(lambda v: [v.start], lambda u: [u.end + gap(u)], True)
        ended = Order(lambda v: [v.end], lambda u: [u.start - gap(u)])
        found = _before(points, parts, keys, started, folds, s, s).withColumnsRenamed({f"_f_{n}": f"_s_{n}" for n in folds})
        found = _with(found, _before(points, parts, keys, ended, folds, s, s), on)
        found = found.select(*on, *((F.col(f"_s_{n}") - F.coalesce(f"_f_{n}", F.lit(0))).alias(f"_f_{n}") for n in folds))
    else:
        width = bin_width(us, vs, start, end, pred.reach) if pred.reach is not None else None
        found = pairs(points, parts, pred, by=by, chrom=chrom, start=start, end=end, width=width)
        found = found.groupBy(*on).agg(*(f.merge(F.col(f"{RIGHT}_p_{n}")).alias(f"_f_{n}") for n, f in folds.items()))
    value = lambda n, f: F.col(f"_f_{n}") if f.empty is None else F.coalesce(F.col(f"_f_{n}"), F.lit(f.empty))
    return _with(us, found, on).select(*us.columns, *(value(n, f).alias(n) for n, f in folds.items()))


def extremes(us: DataFrame, vs: DataFrame, *preds: Pred, x: str, folds: dict[str, Fold], largest: bool = False, into: str = "value", by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of us that has a match with x, the least (or largest) x of its matches and folds of those that attain it. Matches are looked up twice and never gathered."""
    pred, keys = requires(*preds), [*by, *((chrom,) if chrom else ())]
    vs = vs.withColumn("_x", F.col(x))
    on, of = (_seen(df, pred, *keys, start, end) for df in (us, vs))
    how = {"chrom": chrom, "start": start, "end": end, "width": bin_width(us, vs, start, end, pred.reach) if pred.reach is not None else None}
    best = (most if largest else least)("_x")
    parts = vs.groupBy(*of).agg(best.part.on().alias("_p"))
    found = pairs(us.select(*on).distinct(), parts, pred, by=by, **how).groupBy(*on).agg(best.merge(F.col("r__p")).alias("_x"))
    parts = vs.groupBy(*dict.fromkeys((*of, "_x"))).agg(*(f.part.on().alias(f"_p_{n}") for n, f in folds.items()))
    found = pairs(found, parts, pred, by=(*by, "_x"), **how).groupBy(*on, "_x").agg(*(f.merge(F.col(f"r__p_{n}")).alias(n) for n, f in folds.items()))
    return _with(us, found, on).where("_x is not null").withColumnRenamed("_x", into)


def first_matches(us: DataFrame, vs: DataFrame, *preds: Pred, n: int, names: tuple[str, ...], into: str = "matches", by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """As matches, the first n only: of rows that predicates see alike no more than n take part."""
    pred, keys = requires(*preds), [*by, *((chrom,) if chrom else ())]
    on, of = (_seen(df, pred, *keys, start, end) for df in (us, vs))
    top = lambda df, cols, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*cols).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    width = bin_width(us, vs, start, end, pred.reach) if pred.reach is not None else None
    rows = vs.select(*dict.fromkeys((*of, *names)))
    found = top(pairs(us.select(*on).distinct(), top(rows, of, names), pred, by=by, chrom=chrom, start=start, end=end, width=width), on, [RIGHT + c for c in names])
    found = found.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*(F.col(RIGHT + c).alias(c) for c in names)))).alias(into))
    out = _with(us, found, on)
    return out.withColumn(into, F.coalesce(into, F.array().cast(out.schema[into].dataType)))


def without(us: DataFrame, vs: DataFrame, *preds: Pred, by: tuple[str, ...] = (), chrom: str | None = "chrom", start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Rows of us that no row of vs matches. Rows that have a match are told by what they hold; no match is counted."""
    hit = prefixed(pairs(us, vs, *preds, by=by, chrom=chrom, start=start, end=end, width=width).select(*us.columns).distinct(), "h_")
    same = F.lit(True)
    for c in us.columns:
        same = same & F.col(c).eqNullSafe(F.col("h_" + c))
    return us.join(hit, same, "left_anti")


def matches(us: DataFrame, vs: DataFrame, *preds: Pred, names: tuple[str, ...], into: str = "matches", **how) -> DataFrame:
    """Left-grouped join: each row of us and the sorted array of its matches' named columns."""
    from ..functions.aggs import Agg

    rows = Agg(lambda c: F.array_sort(F.collect_list(F.when(c("_hit").isNotNull(), F.struct(*(c(n).alias(n) for n in names))))))
    return grouped(us, vs, *preds, aggs={into: rows}, **how)


def landmark_pairs(marks: DataFrame, us: DataFrame, vs: DataFrame, see: Pred, *preds: Pred, key: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """Pairs of a row of us and one of vs that see the same landmark and fit preds. marks' columns, us' with prefix u_, vs' with prefix v_.

    If preds have a reach, all three meet in bins: a row of us widened by the reach meets vs' row and the landmark, and three stretches
    that meet by twos have a point in common, the last of their starts; it tells the one bin in which they count. Pairs are not sent.
    Else rows meet on the landmark's key, by equality; where screens pairs.
    """
    fit = requires(*preds)
    if see.reach is None or fit.reach is None:
        seen = pairs(marks, us, see).select(*marks.columns, *(F.col(RIGHT + c).alias("u_" + c) for c in us.columns))
        also = pairs(marks, vs, see).select(*(F.col(k).alias("_k_" + k) for k in key), *(F.col(RIGHT + c).alias("v_" + c) for c in vs.columns))
        cond = fit(side("v_"), side("u_"))
        for k in key:
            cond = cond & (F.col(k) == F.col("_k_" + k))
        return seen.join(also, cond if where is None else cond & where).drop(*("_k_" + k for k in key))
    m, u, v = side(), side("u_"), side("v_")
    width = bin_width(marks, us.select("start", "end").union(vs.select("start", "end")))
    rows = marks.withColumn("_bin", _bins(m.start - see.reach, m.end + see.reach, width))
    left = prefixed(us, "u_").withColumn("_u_bin", _bins(u.start - fit.reach, u.end + fit.reach, width))
    right = prefixed(vs, "v_").withColumn("_v_bin", _bins(v.start, v.end, width))
    once = F.col("_bin") == F.floor(F.greatest(m.start - see.reach, u.start - fit.reach, v.start) / width)
    out = rows.join(left, (m.chrom == u.chrom) & (F.col("_bin") == F.col("_u_bin")) & see(u, m))
    cond = (m.chrom == v.chrom) & (F.col("_bin") == F.col("_v_bin")) & see(v, m) & fit(v, u) & once
    return out.join(right, cond if where is None else cond & where).drop("_bin", "_u_bin", "_v_bin")


def star(us: DataFrame, key: tuple[str, ...], **sides: DataFrame) -> DataFrame:
    """us with the results of several left-grouped joins, each made from us by itself; they meet on us' key, so matches never multiply. sides: name -> result of matches() or grouped()."""
    out = us
    for name, s in sides.items():
        extra = [c for c in s.columns if c not in us.columns]
        out = out.join(s.select(*key, *(F.col(c).alias(name if len(extra) == 1 else f"{name}_{c}") for c in extra)), list(key), "left")
    return out


def ratio_pairs(us: DataFrame, vs: DataFrame, key: str, x: float, *screens: Pred, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose sizes (key) differ by less than a factor x: bins are powers of x, and a match is in the same or the next one."""
    level = lambda c: F.floor(F.log(c) / F.log(F.lit(float(x)))).cast("long")
    u, v = side(LEFT, None, key, key), side(RIGHT, None, key, key)
    left = us.where(F.col(key) > 0).withColumn("_bin", F.explode(F.sequence(level(F.col(key)) - 1, level(F.col(key)) + 1)))
    right = prefixed(vs.where(F.col(key) > 0)).withColumn("r__bin", level(F.col(RIGHT + key)))
    cond = (F.col("_bin") == F.col("r__bin")) & (F.greatest(u.start, v.start) < F.least(u.start, v.start) * F.lit(float(x)))
    for s in screens:
        cond = cond & s(v, u)
    for k in by:
        cond = cond & (F.col(k) == F.col(RIGHT + k))
    return left.join(right, cond).drop("_bin", "r__bin")


def running(df: DataFrame, keys: list[str], pos: str, order: list, into: dict[str, Column], stretch: float = STRETCH, best: bool = False, own: bool = True, kind: str | None = None) -> DataFrame:
    """df and for each name of into the sum (best: the maximum; or as kind says, sum, min or max) of its value over rows of the same keys up to a row in order of pos, then order; own: the row's too.

    Summed in stretches of positions; a stretch's rows are one window, and the stretches before come from a table of
    one row a stretch, so no task holds a whole key.
    """
    kind = kind or ("max" if best else "sum")
    gather = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
    cut = df.withColumns({"_stretch": F.floor(F.col(pos) / stretch)} | {f"_value_{n}": v for n, v in into.items()})
    sums = cut.groupBy(*keys, "_stretch").agg(*(gather(f"_value_{n}").alias(f"_sum_{n}") for n in into))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_stretch", *(gather(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in into))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = cut.withColumns({f"_inside_{n}": gather(f"_value_{n}").over(inside) for n in into}).join(sums, [*keys, "_stretch"])
    zero = F.lit(0)
    meet = {"sum": lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), "min": F.least, "max": F.greatest}[kind]
    both = {n: meet(f"_inside_{n}", f"_before_{n}") for n in into}
    return out.withColumns(both).select(*df.columns, *into)


def neighbours(df: DataFrame, keys: list[str], pos: str, names: list[str], order: tuple[str, ...] = (), stretch: float = STRETCH) -> DataFrame:
    """df and _left, _right: structs of names of the rows before and after in order of pos, then order; null at the ends. In stretches, as running."""
    row, place = F.struct(*names), F.struct(pos, *order)
    own = df.withColumn("_stretch", F.floor(F.col(pos) / stretch))
    ends = own.groupBy(*keys, "_stretch").agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"))
    line = Window.partitionBy(*keys).orderBy("_stretch")
    ends = ends.select(*keys, "_stretch", F.lag("_last").over(line).alias("_before"), F.lead("_first").over(line).alias("_after"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(pos, *order)
    out = own.withColumn("_l", F.lag(row).over(inside)).withColumn("_r", F.lead(row).over(inside)).join(ends, [*keys, "_stretch"])
    return out.select(*df.columns, F.coalesce("_l", "_before").alias("_left"), F.coalesce("_r", "_after").alias("_right"))


def _ranked(us: DataFrame, vs: DataFrame, keys: list[str], u_pos: str, v_pos: str, v_first: bool, ties: list[Column]) -> tuple[DataFrame, DataFrame]:
    """us with _n, the rows of vs before its position (at it too, if v_first), and vs with its rank _k from 1."""
    left = us.select(*keys, F.col(u_pos).alias("_pos"), F.lit(1 if v_first else 0).alias("_kind"), F.struct(*us.columns).alias("_u"), F.lit(None).cast(vs.select(F.struct(*vs.columns)).schema[0].dataType).alias("_v"), F.lit(0).alias("_one"))
    right = vs.select(*keys, F.col(v_pos).alias("_pos"), F.lit(0 if v_first else 1).alias("_kind"), F.lit(None).cast(us.select(F.struct(*us.columns)).schema[0].dataType).alias("_u"), F.struct(*vs.columns).alias("_v"), F.lit(1).alias("_one"))
    every = running(left.union(right), keys, "_pos", ["_kind", *ties], {"_n": F.col("_one")})
    return every.where("_one = 0").select("_u.*", "_n"), every.where("_one = 1").select("_v.*", F.col("_n").alias("_k"))


def _classes(us: DataFrame, vs: DataFrame, stranded: bool) -> tuple[DataFrame, DataFrame]:
    """Both with _class, equal if strands are compatible: a row of vs is in each class of us' strands that it fits."""
    if not stranded:
        return us.withColumn("_class", F.lit(".")), vs.withColumn("_class", F.lit("."))
    known = F.col("strand").isin("+", "-")
    own = us.withColumn("_class", F.when(known, F.col("strand")).otherwise("."))
    return own, vs.withColumn("_class", F.explode(F.when(known, F.array("strand", F.lit("."))).otherwise(F.array(F.lit("+"), F.lit("-"), F.lit(".")))))


def _by_rank(own: DataFrame, others: DataFrame, keys: list[str], n: int, up: bool) -> DataFrame:
    rest = [c for c in others.columns if c not in ("start", "end", *keys)]
    if up:
        # of equal ends, the first in order of locus is the nearest, so it comes last
        left, right = _ranked(own, others, keys, "start", "end", False, [F.desc("_v.start"), *(F.desc(f"_v.{c}") for c in rest)])
        left = left.where("_n > 0")
        wanted = F.sequence(F.greatest(F.col("_n") - (n - 1), F.lit(1)), F.col("_n"))
    else:
        left, right = _ranked(own, others, keys, "end", "start", True, [F.asc("_v.end"), *(F.asc(f"_v.{c}") for c in rest)])
        wanted = F.sequence(F.col("_n") + 1, F.col("_n") + n)
    left, right = left.withColumn("_k", F.explode(wanted)), prefixed(right)
    cond = F.col("_k") == F.col("r__k")
    for k in keys:
        cond = cond & (F.col(k) == F.col(RIGHT + k))
    return left.join(right, cond).drop("_n", "_k", "r__k", "r__class")


def upstream(us: DataFrame, vs: DataFrame, n: int = 1, by: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """Of each row of us, and with prefix r_, the last n of vs in order of locus that end before it starts. Rows without one are left out.

    The last is a running maximum. Where a row meets the maximum so far, the lesser of the two drops out of
    that race, and the second is the running maximum of those that dropped out; so on to the n-th.
    """
    keys = [*by, "chrom", "_class"]
    own, others = _classes(counted(us), vs, stranded)
    names = ["start", "end", *(c for c in vs.columns if c not in ("start", "end"))]
    u_type, v_type = own.select(F.struct(*own.columns)).schema[0].dataType, others.select(F.struct(*names)).schema[0].dataType
    left = own.select(*keys, F.col("start").alias("_pos"), F.lit(0).alias("_kind"), F.struct(*own.columns).alias("_u"), F.lit(None).cast(v_type).alias("_v"))
    right = others.select(*keys, F.col("end").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(u_type).alias("_u"), F.struct(*names).alias("_v"))
    every, tie = left.union(right), F.xxhash64("_v")
    for k in range(n):
        every = running(every, keys, "_pos", ["_kind", tie], {f"_last{k}": F.col("_v")}, best=True)
        if k + 1 < n:
            every = running(every, keys, "_pos", ["_kind", tie], {"_before": F.col("_v")}, best=True, own=False)
            every = every.withColumn("_v", F.when(F.col("_before").isNotNull() & F.col("_v").isNotNull(), F.least("_v", "_before"))).drop("_before")
    found = every.where("_kind = 0").select("_u.*", F.explode(F.array(*(f"_last{k}" for k in range(n)))).alias("_last")).where("_last is not null")
    return repeated(found.select(*us.columns, "_copies", *(F.col(f"_last.{c}").alias(RIGHT + c) for c in vs.columns)))


def downstream(us: DataFrame, vs: DataFrame, n: int = 1, by: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """Of each row of us the first n of vs in order of locus that start after it ends."""
    own, others = _classes(us, vs, stranded)
    return _by_rank(own, others, [*by, "chrom", "_class"], n, up=False).drop("_class")


def nearest(us: DataFrame, vs: DataFrame, n: int = 1, by: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """Of each row of us the n of vs with the least gap before or behind it, at ties the first in order of locus. What overlaps or touches isn't near.

    The n nearest are among the n before and the n behind, which are found by rank.
    """
    keys = [*by, "chrom", "_class"]
    own, others = _classes(counted(us), vs, stranded)
    found = _by_rank(own, others, keys, n, True).unionByName(_by_rank(own, others, keys, n, False))
    w = Window.partitionBy(*us.columns).orderBy(F.greatest(F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end")), "r_start", "r_end", *(RIGHT + c for c in vs.columns if c not in ("start", "end")))
    return repeated(found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)).drop("_n", "_class")


#: Rows of vs within, before and after a row's own distance _t.
_NEARER = Pred("nearer", lambda v, u: distance(v, u) <= u.col("_t"), span=Span(lambda u: u.col("_t")), sees=("_t",))
_BEHIND = Pred("behind", lambda v, u: v.end < u.start - u.col("_t"), order=Order(lambda s: [s.end], lambda s: [s.start - s.col("_t")]), sees=("_t",))
_AHEAD = Pred("ahead", lambda v, u: v.start > u.end + u.col("_t"), order=Order(lambda s: [-s.start], lambda s: [-(s.end + s.col("_t"))]), sees=("_t",))
_BEYOND = Pred("beyond", lambda v, u: distance(v, u) > u.col("_t"))
_APART = Pred("apart", lambda v, u: (v.end < u.start) | (v.start > u.end))


def _reached(points: DataFrame, parts: DataFrame, n: int, screens: list[Pred], by: tuple[str, ...], width: int | None) -> DataFrame:
    """points that have a match, with _t, the distance of their n-th (of the last, if they have fewer). A round finds the next distance of those that lack some; only least distances are kept."""

    def step(left: DataFrame, *more: Pred) -> DataFrame:
        v, u = side(RIGHT), side()
        return pairs(left, parts, *screens, *more, by=by, width=width).groupBy(*points.columns).agg(F.min(distance(v, u)).alias("_t"))

    out = step(points)
    for _ in range(n - 1):
        held = pairs(out, parts, *screens, _NEARER, by=by, width=width, reach=F.col("_t")).groupBy(*out.columns).agg(F.sum("r__m").alias("_c"))
        further = step(held.where(F.col("_c") < n), _BEYOND).withColumnRenamed("_t", "_next")
        out = _with(held.drop("_c"), further, points.columns).select(*points.columns, F.coalesce("_next", "_t").alias("_t"))
    return out


def _reached_by_rank(points: DataFrame, vs: DataFrame, n: int, by: tuple[str, ...], include_overlap: bool) -> DataFrame:
    """The same where distance alone counts, without pairs: the next distance is that of the last end before or the first start behind, and how many are up to there is a count over a span."""
    own, others = _classes(points, vs.select(*by, "chrom", "start", "end", "strand"), True)
    keys, here = [*by, "_class", "chrom"], side()
    parts = others.groupBy(*keys, "start", "end").agg(F.max("end").alias("_p_e"), F.min("start").alias("_p_s"))
    fold = lambda df, pred, **f: folded(df, others, pred, folds=f, by=(*by, "_class"))
    out, some = own.withColumn("_t", F.lit(0)), F.col("_c") - F.col("_o")
    if include_overlap or n > 1:
        out = cut_lineage(fold(out, _NEARER, _c=tally()).withColumn("_o", F.lit(0).cast("long") if include_overlap else F.col("_c")))
    else:
        out = out.withColumns({"_c": F.lit(0).cast("long"), "_o": F.lit(0).cast("long")})
    done = []
    for k in range(n):
        if include_overlap or k:
            done.append(out.where(some >= n))
            out = out.where(some < n)
        last, first = (_before(out, parts, keys, p.order, f, here, here) for p, f in ((_BEHIND, {"e": most("end")}), (_AHEAD, {"s": least("start")})))
        out = _with(last, first.select(*points.columns, "_f_s"), points.columns)
        further = F.least(F.col("start") - F.col("_f_e"), F.col("_f_s") - F.col("end"))
        out = out.withColumn("_t", F.coalesce(further, F.when(some > 0, F.col("_t")))).drop("_f_e", "_f_s").where("_t is not null")
        if k + 1 < n:
            out = cut_lineage(fold(cut_lineage(out.drop("_c")), _NEARER, _c=tally()))
    for df in done:
        out = out.unionByName(df)
    return out.select(*points.columns, "_t")


def closest(us: DataFrame, vs: DataFrame, *preds: Pred, n: int = 1, by: tuple[str, ...] = (), ties: bool = False, include_overlap: bool = False) -> DataFrame:
    """Of the pairs on compatible strands that fit all preds, the n nearest of each row of us. ties: all at the n-th distance; include_overlap: what overlaps or touches has distance 0, else it isn't near.

    First how far the n-th is, then the pairs up to there; what lies farther is neither held nor sent.
    """
    us, vs = (df.where(F.col("strand").isNotNull()) for df in (us, vs))
    gap_alone = len(preds) == 1 and preds[0].span is not None and preds[0].span.length is None
    pred = requires(*preds, same_strand())
    screens = [pred] if include_overlap else [pred, _APART]
    on, of = (_seen(df, pred, *by, "chrom", "start", "end") for df in (us, vs))
    points, parts = us.select(*on).distinct(), vs.groupBy(*of).agg(F.count(F.lit(1)).alias("_m"))
    if gap_alone:
        limits = _reached_by_rank(points, vs, n, by, include_overlap)
    else:
        limits = _reached(points, parts, n, screens, by, bin_width(us, vs, reach=pred.reach) if pred.reach is not None else None)
    if ties:
        rows = _with(us, limits, on).where("_t is not null")
        return pairs(rows, vs, *screens, _NEARER, by=by, width=bin_width(us, vs), reach=F.col("_t")).drop("_t")
    # of rows that predicates see alike no more than n take part, and us' rows come last
    order = ["start", "end", *(c for c in vs.columns if c not in ("start", "end"))]
    top = lambda df, cols, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*cols).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    best = top(vs, of, order)
    if n == 1 and not include_overlap:  # all lie just so far before or behind
        right, cond = prefixed(best), requires(*screens)(side(RIGHT), side()) & (F.col("chrom") == F.col("r_chrom"))
        for k in by:
            cond = cond & (F.col(k) == F.col(RIGHT + k))
        found = limits.join(right, cond & (F.col("r_end") == F.col("start") - F.col("_t"))).unionByName(limits.join(right, cond & (F.col("r_start") == F.col("end") + F.col("_t"))))
    else:
        found = pairs(limits, best, *screens, _NEARER, by=by, width=bin_width(us, vs), reach=F.col("_t"))
    found = top(found, on, [distance(side(RIGHT), side()), *(RIGHT + c for c in order)])
    return _with(us, found.select(*on, *(RIGHT + c for c in vs.columns)), on).where("r_start is not null").select(*us.columns, *(RIGHT + c for c in vs.columns))
