"""Datasets of samples: a table of metadata (sid and more) and a table of their regions (sid and an interval).

Region operations take by=("sid",), so all samples run in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import Agg
from . import regions
from .joins import RIGHT, prefixed

SID = ("sid",)


def named(*keys: str) -> Column:
    """A name of the keys' values, joined by bars; null is \\N, and bars and backslashes in values are escaped, so no two lists share one."""
    return F.concat_ws("|", *(F.coalesce(F.regexp_replace(F.col(k).cast("string"), r"([\\|])", r"\\$1"), F.lit("\\N")) for k in keys))


# Metadata of a pair of samples, from the columns of one and of the other (prefix r_).

SampleOutput = Callable[[list[str], list[str]], list[Column]]


def keep_left(us: list[str], vs: list[str]) -> list[Column]:
    return [F.col(c) for c in us]


def keep_right(us: list[str], vs: list[str]) -> list[Column]:
    return [F.col(RIGHT + c).alias(c) for c in vs]


def overwrite(rename: Callable[[str], str] = lambda n: RIGHT + n) -> SampleOutput:
    """Both; the other's are renamed, and hide what has the same name."""

    def out(us: list[str], vs: list[str]) -> list[Column]:
        new = {rename(c): F.col(RIGHT + c).alias(rename(c)) for c in vs}
        return [*(F.col(c) for c in us if c not in new), *new.values()]

    return out


@dataclass(frozen=True)
class Dataset:
    samples: DataFrame
    regions: DataFrame

    # One dataset.

    def select_s(self, where: Column | str) -> Dataset:
        kept = self.samples.where(where)
        return Dataset(kept, self.regions.join(kept.select("sid"), "sid", "left_semi"))

    def project_s(self, **exprs: Column) -> Dataset:
        """Metadata becomes exprs alone; sid stays to name the sample."""
        return replace(self, samples=self.samples.select("sid", *(e.alias(n) for n, e in exprs.items() if n != "sid")))

    def extend_s(self, **exprs: Column | Agg) -> Dataset:
        """New metadata: of a Column over metadata, or an Agg over the sample's regions."""
        tracks = {n: e for n, e in exprs.items() if isinstance(e, Agg)}
        out = self.samples.withColumns({n: e for n, e in exprs.items() if n not in tracks})
        if tracks:
            mark = self.samples.select("sid").distinct().join(self.regions, "sid", "left")
            per = mark.groupBy("sid").agg(*(a.on().alias(n) for n, a in tracks.items()))
            out = out.drop(*tracks).join(per, "sid", "left")
        return replace(self, samples=out)

    def on_region(self, f: Callable[[DataFrame], DataFrame]) -> Dataset:
        """f makes a regions table of another; it must keep sid apart (by=SID)."""
        return replace(self, regions=f(self.regions))

    def rename_meta(self, **names: str) -> Dataset:
        return replace(self, samples=self.samples.withColumnsRenamed(names))

    def delete_meta(self, *names: str) -> Dataset:
        return replace(self, samples=self.samples.drop(*names))

    def merge_meta(self, **exprs: Column) -> Dataset:
        """New metadata where there is none yet."""
        return replace(self, samples=self.samples.withColumns({n: F.coalesce(n, e) if n in self.samples.columns else e for n, e in exprs.items()}))

    def merge_track(self, other: DataFrame) -> Dataset:
        return replace(self, regions=regions.union_r(self.regions, other))

    def delete_track_meta(self, *names: str) -> Dataset:
        return replace(self, regions=self.regions.drop(*names))

    def sorted(self) -> Dataset:
        return replace(self, regions=self.regions.orderBy("sid", "chrom", "start", "end"))

    def track_sizes(self) -> DataFrame:
        return self.extend_s(track_size=_count()).samples.select("sid", "track_size")

    def group_s(self, *keys: str, **aggs: Agg) -> Dataset:
        """Each sample stays, with aggregates of its group's metadata."""
        w = Window.partitionBy(*keys)
        return replace(self, samples=self.samples.withColumns({n: a.over(w) for n, a in aggs.items()}))

    def cover_s(self, f: Callable[[DataFrame, tuple[str, ...]], DataFrame], *keys: str) -> Dataset:
        """A sample a group of equal keys (one of all without keys), whose regions are f of the group's; metadata are the keys. sid names the keys' values; null keys are equal."""
        name = named(*keys) if keys else F.lit("all")
        own = self.samples.select(F.col("sid").alias("_old"), name.alias("sid"), *keys)
        rows = self.regions.withColumnRenamed("sid", "_old").join(own.select("_old", "sid"), "_old").drop("_old")
        return Dataset(own.drop("_old").distinct(), f(rows, SID))

    # Two datasets.

    def semijoin(self, other: Dataset, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Dataset:
        """Samples for which some other one agrees on all of include and differs on all of exclude. A missing value never agrees; missing on the other side differs."""
        t = prefixed(other.samples)
        cond = F.lit(True)
        for k in include:
            cond = cond & (F.col(k) == F.col(RIGHT + k))
        for k in exclude:
            cond = cond & (F.col(RIGHT + k).isNull() | (F.col(k) != F.col(RIGHT + k)))
        kept = self.samples.join(t, cond, "left_semi")
        return Dataset(kept, self.regions.join(kept.select("sid"), "sid", "left_semi"))

    def paired(self, other: Dataset, joinby: tuple[str, ...] = (), on: Callable[[], Column] | None = None) -> DataFrame:
        """Metadata of joinable pairs; the other's with prefix r_."""
        t = prefixed(other.samples)
        cond = on() if on else F.lit(True)
        for k in joinby:
            cond = cond & (F.col(k) == F.col(RIGHT + k))
        return self.samples.join(t, cond)

    def join_s(self, other: Dataset, joinby: tuple[str, ...] = (), on_region: Callable[[DataFrame, DataFrame, tuple[str, ...]], DataFrame] | None = None, on: Callable[[], Column] | None = None, on_sample: SampleOutput | None = None) -> Dataset:
        """A sample a joinable pair: sid names the pair; regions by on_region, by default pairs that overlap; metadata by on_sample, by default both."""
        from ..functions.predicates import overlap

        make = on_region or (lambda u, v, by: regions.join_r(u, v, overlap(1), by=by))
        met = self.paired(other, joinby, on).withColumn("_pair", named("sid", "r_sid"))
        u = self.regions.join(met.select("sid", "_pair"), "sid").drop("sid").withColumnRenamed("_pair", "sid")
        v = other.regions.join(met.select(F.col("r_sid").alias("sid"), "_pair"), "sid").drop("sid").withColumnRenamed("_pair", "sid")
        meta = lambda ds: [c for c in ds.samples.columns if c != "sid"]
        return Dataset(met.select(F.col("_pair").alias("sid"), *(on_sample or overwrite())(meta(self), meta(other))), make(u, v, SID))

    def map_s(self, other: Dataset, joinby: tuple[str, ...] = (), counter: str = "count", on: Callable[[], Column] | None = None, **aggs: Agg) -> Dataset:
        """A sample a joinable pair: its own metadata and regions, with the number of the other's that overlap and aggregates of them."""
        return self.join_s(other, joinby, lambda u, v, by: regions.map_r(u, v, by, counter, **aggs), on, keep_left)

    def difference_s(self, other: Dataset, joinby: tuple[str, ...] = (), exact: bool = False, on: Callable[[], Column] | None = None) -> Dataset:
        """Each sample's regions without those that overlap one of any joinable sample. Without a joinable one: unchanged."""
        met = self.paired(other, joinby, on).select("sid", "r_sid")
        v = other.regions.withColumnRenamed("sid", "r_sid").join(met, "r_sid").drop("r_sid")
        return replace(self, regions=regions.difference_r(self.regions, v, by=SID, exact=exact))


def _count() -> Agg:
    from ..functions.aggs import count

    return count("chrom")
