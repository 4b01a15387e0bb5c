"""Coverage: how many regions lie over each stretch of a chromosome, and what follows from it.

A region adds one at its start and takes it away at its end; the sum up to a position is the
depth from there to the next position. No join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import Agg
from ..functions.predicates import overlap, same_strand
from . import joins, regions

Depth = Callable[[Column], Column]


def at_least(n: int) -> Depth:
    return lambda d: d >= n


def at_most(n: int) -> Depth:
    return lambda d: d <= n


def between(lo: int, hi: int) -> Depth:
    return lambda d: d.between(lo, hi)


def exactly(n: int) -> Depth:
    return lambda d: d == n


def _keys(by: tuple[str, ...]) -> list[str]:
    return [*by, "chrom", "strand"]


def _stranded(df: DataFrame, by: tuple[str, ...], stranded: bool) -> DataFrame:
    own = df.select(*by, "chrom", "start", "end", "strand")
    if not stranded:
        return own.withColumn("strand", F.lit("."))
    known = F.col("strand").isin("+", "-")
    return own.withColumn("strand", F.explode(F.when(known, F.array("strand")).otherwise(F.array(F.lit("+"), F.lit("-")))))


def depths(df: DataFrame, by: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """by, chrom, strand, start, end, htIndex: the longest stretches of one depth above 0. A dot counts on both strands."""
    keys = _keys(by)
    own = _stranded(df, by, stranded).where("start < end")
    points = own.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("p"))
    steps = points.groupBy(*keys, F.col("p.at").alias("at")).agg(F.sum("p.d").alias("d")).where("d <> 0")
    # the next position is in the same stretch, or the first of the next one that has any
    cut = F.floor(F.col("at") / joins.STRETCH)
    own = steps.withColumn("_s", cut)
    sums = own.groupBy(*keys, "_s").agg(F.sum("d").alias("_sum"), F.min("at").alias("_min"))
    line = Window.partitionBy(*keys).orderBy("_s")
    sums = sums.select(*keys, "_s", F.coalesce(F.sum("_sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_min").over(line).alias("_after"))
    inside = Window.partitionBy(*keys, "_s").orderBy("at")
    out = own.withColumn("_in", F.sum("d").over(inside)).withColumn("_next", F.lead("at").over(inside)).join(sums, [*keys, "_s"])
    out = out.select(*keys, F.col("at").alias("start"), F.coalesce("_next", "_after").alias("end"), (F.col("_in") + F.col("_before")).alias("htIndex"))
    return out.where("htIndex > 0")


def _row(df: DataFrame, by: tuple[str, ...], *extra: str) -> DataFrame:
    return df.select(*by, "chrom", "start", "end", F.lit("").alias("name"), F.lit(0).alias("score"), "strand", *extra)


def _finish(df: DataFrame, source: DataFrame, by: tuple[str, ...], aggs: dict[str, Agg]) -> DataFrame:
    out = _row(df, by, "htIndex")
    return regions.map_r(out, source, by, "accIndex", **aggs) if aggs else out


def _islands(df: DataFrame, keys: list[str], order: tuple[str, ...], *aggs: Column) -> DataFrame:
    """Merges rows that meet those before them, in order of start and order. Ends and counts so far come in stretches of positions."""
    own = joins.running(df, keys, "start", list(order), {"_b": F.col("end")}, best=True, own=False)
    new = F.when(F.col("_b").isNull() | (F.col("_b") < F.col("start")), 1).otherwise(0)
    own = joins.running(own, keys, "start", list(order), {"_id": new})
    return own.groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggs).drop("_id")


def histo(df: DataFrame, depth: Depth, by: tuple[str, ...] = (), stranded: bool = True, **aggs: Agg) -> DataFrame:
    """Stretches of one depth that fits."""
    return _finish(depths(df, by, stranded).where(depth(F.col("htIndex"))), df, by, aggs)


def cover(df: DataFrame, depth: Depth, by: tuple[str, ...] = (), stranded: bool = True, **aggs: Agg) -> DataFrame:
    """Those stretches, merged where they touch; htIndex is the first one's."""
    fit = depths(df, by, stranded).where(depth(F.col("htIndex")))
    return _finish(_islands(fit, _keys(by), (), F.min_by("htIndex", "start").alias("htIndex")), df, by, aggs)


def summit(df: DataFrame, depth: Depth, by: tuple[str, ...] = (), stranded: bool = True, **aggs: Agg) -> DataFrame:
    """Those stretches that are deeper than the ones that they touch."""
    fit = depths(df, by, stranded).where(depth(F.col("htIndex")))
    own = joins.neighbours(fit, _keys(by), "start", ["start", "end", "htIndex"])
    left, right = F.when(F.col("_left.end") == F.col("start"), F.col("_left.htIndex")), F.when(F.col("_right.start") == F.col("end"), F.col("_right.htIndex"))
    return _finish(own.where(F.col("htIndex") > F.greatest(F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0)))), df, by, aggs)


def flat(df: DataFrame, depth: Depth, by: tuple[str, ...] = (), stranded: bool = True, **aggs: Agg) -> DataFrame:
    """The hulls of the regions over those stretches, merged where they meet; htIndex is the first one's."""
    fit = depths(df, by, stranded).where(depth(F.col("htIndex")))
    own = _stranded(df, by, stranded)
    over = joins.pairs(fit, own, overlap(1), by=(*by, "strand"))
    hulls = over.groupBy(*_keys(by), F.col("start").alias("_at"), "htIndex").agg(F.min("r_start").alias("start"), F.max("r_end").alias("end"))
    return _finish(_islands(hulls, _keys(by), ("end", "_at"), F.min_by("htIndex", F.struct("start", "end", "_at")).alias("htIndex")), df, by, aggs)


def complement(df: DataFrame, by: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """Gaps between covered stretches of a chromosome."""
    own = joins.neighbours(depths(df, by, stranded), _keys(by), "start", ["start"]).where("_right.start > end")
    return _row(own.select(*_keys(by), F.col("end").alias("start"), F.col("_right.start").alias("end")), by)


def segments(df: DataFrame, by: tuple[str, ...] = (), stranded: bool = True, widest: bool = False) -> DataFrame:
    """Of each distinct end point with regions over it, a row from it to the nearest of their ends (widest: their hull), and their number."""
    own = _stranded(df, by, stranded)
    points = own.select(*_keys(by), F.explode(F.array("start", "end")).alias("start")).distinct().withColumn("end", F.col("start"))
    over = joins.pairs(points, own, joins_over(), by=(*by, "strand"))
    start = F.min("r_start") if widest else F.first("start")
    end = F.max("r_end") if widest else F.min("r_end")
    out = over.groupBy(*_keys(by), F.col("start").alias("_at")).agg((start if widest else F.min("start")).alias("start"), end.alias("end"), F.count(F.lit(1)).alias("htIndex"))
    return _row(out, by, "htIndex")


def joins_over():
    from ..functions.predicates import Pred

    return Pred("over", lambda v, u: (v.start <= u.start) & (u.start < v.end), True, 0)


__all__ = ["at_least", "at_most", "between", "complement", "cover", "depths", "exactly", "flat", "histo", "same_strand", "segments", "summit"]
