"""Every query of the engine by name, and SQL that gives the same rows.

Intervals come from ``events``: chrom from the user, start from the minute, end from the value,
strand from the type; a sample is an event type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions import predicates as K
from ..operators import coverage as C
from ..operators import joins as J
from ..operators import regions as R
from ..operators.ordered import OrderedFrame
from ..operators.samples import SID, Dataset
from . import proteins as X

#: Added before a computed value is rounded, so that halves, which engines round differently, are none.
TIE = 1e-10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("int") - 28401120
    value = F.floor("value").cast("int")
    strand = F.when(F.col("event_type") == "purchase", "+").when(F.col("event_type") == "error", "-").otherwise(".")
    return e.select(
        F.concat(F.lit("u"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")).alias("chrom"), start.alias("start"), (start + 1 + value).alias("end"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"),
        value.alias("score"), strand.alias("strand"), F.col("event_id").alias("id"), F.col("event_type").alias("sid"),
    )


_VIEW = """iv as (
  select 'u' || lpad(cast(user_id % 25 as varchar), 2, '0') as chrom, cast(floor(epoch(ts) / 60) as int) - 28401120 as start,
    cast(floor(epoch(ts) / 60) as int) - 28401120 + 1 + cast(floor(value) as int) as "end", 'e' || event_id as name, cast(floor(value) as int) as score,
    case event_type when 'purchase' then '+' when 'error' then '-' else '.' end as strand, event_id as id, event_type as sid from events)"""
_OVER = 'v.chrom = u.chrom and v."end" > u.start and u."end" > v.start'
_STRAND = "(v.strand = u.strand or v.strand = '.' or u.strand = '.')"
_GAP = 'greatest(v.start - u."end", u.start - v."end", 0)'


#: Loci that many intervals share: starts and lengths are multiples of 200.
_COARSE = """, co as (select chrom, cast(floor(start / 200) as int) * 200 as start, cast(floor(start / 200) as int) * 200 + 200 * (1 + cast(floor(score / 200) as int)) as "end", name, score, strand, id, sid from iv) """


def coarse(df: DataFrame) -> DataFrame:
    start = (F.floor(F.col("start") / 200) * 200).cast("int")
    return df.withColumns({"start": start, "end": start + 200 * (1 + F.floor(F.col("score") / 200).cast("int"))})


def _track(spark: SparkSession, sf_dir: str, *sids: str) -> DataFrame:
    return intervals(spark, sf_dir).where(F.col("sid").isin(*sids)).drop("sid")


def query(name: str, sql: str | None = None, view: bool = True):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (f"with {_VIEW}" + (", " if sql.lstrip().startswith("--with") else " ") + sql.replace("--with", "")) if view else sql
        return f

    return put


# Map, difference, join.


@query("map_overlap", f"""select u.id, u.chrom, u.start, u."end", u.strand, count(v.id) as "count", round(coalesce(avg(v.score), 0), 6) as average, coalesce(sum(v.score), 0) as total, max(v.score) as biggest
  from iv u left join iv v on v.sid <> 'purchase' and v.sid <> 'error' and {_OVER} and {_STRAND} where u.sid in ('purchase', 'error') group by all""")
def _map(spark, d):
    us, vs = _track(spark, d, "purchase", "error"), intervals(spark, d).where("sid not in ('purchase', 'error')")
    out = R.map_r(us.drop("name", "score"), vs, average=A.average("score"), total=A.total("score"), biggest=A.biggest("score"))
    return out.withColumn("average", F.round("average", 6)).select("id", "chrom", "start", "end", "strand", "count", "average", "total", "biggest")


@query("difference_overlap", f"""select u.* exclude (sid) from iv u where u.sid = 'purchase' and not exists (select 1 from iv v where v.sid in ('error', 'view') and {_OVER} and {_STRAND})""")
def _difference(spark, d):
    return R.difference_r(_track(spark, d, "purchase"), _track(spark, d, "error"), _track(spark, d, "view"))


@query("difference_exact", f"""--with{_COARSE[1:]} select u.* exclude (sid) from co u where u.id % 2 = 0 and not exists (select 1 from co v where v.id % 2 = 1 and {_STRAND} and v.chrom = u.chrom and v.start = u.start and v."end" = u."end")""")
def _difference_exact(spark, d):
    iv = coarse(intervals(spark, d)).drop("sid")
    return R.difference_r(iv.where("id % 2 = 0"), iv.where("id % 2 = 1"), exact=True)


def _join(output):
    def f(spark, d):
        us, vs = _track(spark, d, "purchase", "click"), _track(spark, d, "error", "view")
        return R.join_r(us, vs, K.overlap(1), output=output)

    return f


_JOINED = f"from iv u join iv v on {_OVER} and {_STRAND} where u.sid in ('purchase', 'click') and v.sid in ('error', 'view')"
_U = 'u.chrom, u.start, u."end", u.name, u.score, u.strand, u.id'
query("join_overlap_left", f"select {_U} {_JOINED}")(_join(R.left))
query("join_overlap_right", f'select v.chrom, v.start, v."end", v.name, v.score, v.strand, v.id {_JOINED}')(_join(R.right))
query("join_overlap_int", f'select u.chrom, greatest(u.start, v.start) as start, least(u."end", v."end") as "end", u.name, u.score, u.strand, u.id, v.id as r_id {_JOINED}')(_join(R.intersection()))
query("join_overlap_both", f'select {_U}, v.id as r_id, v.chrom as r_chrom, v.start as r_start, v."end" as r_end {_JOINED}')(_join(R.both()))
query("join_overlap_cat", f'select u.chrom, least(u.start, v.start) as start, greatest(u."end", v."end") as "end", u.name, u.score, u.strand, u.id, v.id as r_id {_JOINED}')(_join(R.hull()))


def _pair_query(name: str, test: str, *preds: K.Pred, u: str = "purchase", v: str = "error", wide: bool = False):
    of = coarse if wide else lambda df: df

    def f(spark, d):
        out = J.pairs(of(_track(spark, d, u)), of(_track(spark, d, v)), *preds)
        return out.select("id", "r_id", "start", "end", "r_start", "r_end")

    t = "co" if wide else "iv"
    query(name, ("--with" + _COARSE[1:] if wide else "") + f"""select u.id, v.id as r_id, u.start, u."end", v.start as r_start, v."end" as r_end from {t} u join {t} v on {test} where u.sid = '{u}' and v.sid = '{v}'""")(f)


_SAME = "v.chrom = u.chrom"
_pair_query("join_near", f"{_SAME} and {_GAP} <= 25", K.near(25))
_pair_query("join_overlap_20", f'{_OVER} and least(v."end", u."end") - greatest(v.start, u.start) >= 20', K.overlap(20))
_pair_query("join_touch", f'{_SAME} and (v."end" = u.start or u."end" = v.start)', K.near(0), K.touch(), v="view", wide=True)
_pair_query("join_inside", f'{_SAME} and u.start <= v.start and v."end" <= u."end"', K.overlap(0, strict=False), K.inside(), v="view")
_pair_query("join_enclose", f'{_SAME} and v.start <= u.start and u."end" <= v."end"', K.overlap(0, strict=False), K.enclose(), v="view")
_pair_query("join_far_within", f"{_SAME} and {_GAP} <= 60 and {_GAP} >= 20", K.near(60), K.far(20))
_pair_query("join_same_start", f"{_SAME} and v.start = u.start", K.same_start(), v="view", wide=True)
_pair_query("join_overlap_start", f'{_SAME} and v.start <= u.start and u.start <= v."end"', K.overlap_start())
_pair_query("join_overlap_end", f'{_SAME} and v.start <= u."end" and u."end" <= v."end" and {_GAP} = 0', K.near(0), K.overlap_end())
_pair_query("join_upstream_within", f'{_SAME} and v."end" < u.start and {_GAP} < 40', K.interval_dl(40), K.end_before())
_pair_query("join_downstream_within", f'{_SAME} and v.start > u."end" and {_GAP} < 40', K.interval_dl(40), K.start_after())
_pair_query("join_size_ratio", f'{_OVER} and greatest(v."end" - v.start, u."end" - u.start) < least(v."end" - v.start, u."end" - u.start) * 1.5', K.overlap(1), K.size_percent(1.5))


# Nearest.


def _nearest(how, n):
    def f(spark, d):
        return R.nearest_r(_track(spark, d, "purchase"), _track(spark, d, "error", "view"), n, how=how, output=R.both()).select("id", "r_id", "r_start", "r_end")

    return f


def _nearest_sql(test: str, order: str, n: int) -> str:
    return f"""select id, r_id, r_start, r_end from (select u.id, v.id as r_id, v.start as r_start, v."end" as r_end, row_number() over (partition by u.id order by {order}) as k
      from iv u join iv v on {_SAME} and {_STRAND} and ({test}) where u.sid = 'purchase' and v.sid in ('error', 'view')) where k <= {n}"""


_BEFORE, _AFTER = 'v."end" < u.start', 'v.start > u."end"'
_LOCUS = 'v.start, v."end"'
_REST = "v.name, v.score, v.strand, v.id"
query("nearest_md1", _nearest_sql(f"{_BEFORE} or {_AFTER}", f"{_GAP}, {_LOCUS}, v.chrom, {_REST}", 1))(_nearest(J.nearest, 1))
query("nearest_md3", _nearest_sql(f"{_BEFORE} or {_AFTER}", f"{_GAP}, {_LOCUS}, v.chrom, {_REST}", 3))(_nearest(J.nearest, 3))
query("nearest_upstream", _nearest_sql(_BEFORE, "v.start desc, v.\"end\" desc, v.name desc, v.score desc, v.strand desc, v.id desc", 1))(_nearest(J.upstream, 1))
query("nearest_upstream_2", _nearest_sql(_BEFORE, "v.start desc, v.\"end\" desc, v.name desc, v.score desc, v.strand desc, v.id desc", 2))(_nearest(J.upstream, 2))


@query("nearest_downstream", f"""select id, r_start, r_end from (select u.id, v.start as r_start, v."end" as r_end, row_number() over (partition by u.id order by v.start, v."end") as k
  from iv u join iv v on {_SAME} and {_STRAND} and {_AFTER} where u.sid = 'purchase' and v.sid in ('error', 'view')) where k <= 2""")
def _downstream(spark, d):
    return _nearest(J.downstream, 2)(spark, d).select("id", "r_start", "r_end")


def _screened(f):
    return lambda spark, d: f(_track(spark, d, "purchase"), _track(spark, d, "view"), K.near(80), K.general(lambda v, u: v.col("score") > u.col("score"), sees=("score",)), n=1).select("id", "r_id")


_NEAR80 = f"{_SAME} and {_STRAND} and {_GAP} <= 80 and {_GAP} > 0 and u.sid = 'purchase' and v.sid = 'view'"
query("nearest_inner", f"select id, r_id from (select u.id, v.id as r_id, row_number() over (partition by u.id order by {_GAP}, {_LOCUS}, {_REST}) as k from iv u join iv v on {_NEAR80} and v.score > u.score) where k = 1")(_screened(R.inner_nearest_r))
query("nearest_outer", f"select id, r_id from (select u.id, v.id as r_id, v.score > u.score as ok, row_number() over (partition by u.id order by {_GAP}, {_LOCUS}, {_REST}) as k from iv u join iv v on {_NEAR80}) where k = 1 and ok")(_screened(R.outer_nearest_r))


@query("nearest_ties", f"""select id, r_id from (select u.id, v.id as r_id, rank() over (partition by u.id order by {_GAP}) as k from iv u join iv v on {_SAME} and {_STRAND} and {_GAP} <= 100 where u.sid = 'purchase' and v.sid = 'view') where k <= 2""")
def _ties(spark, d):
    return R.inner_nearest_r(_track(spark, d, "purchase"), _track(spark, d, "view"), K.near(100), n=2, ties=True, include_overlap=True).select("id", "r_id")


# Groups of loci; rows.


@query("partition_by_locus", f"""--with{_COARSE[1:]} select chrom, start, "end", '' as name, 0 as score, '.' as strand, count(*) as n, max(score) as biggest from co group by chrom, start, "end" """)
def _partition(spark, d):
    return R.partition_r(coarse(intervals(spark, d)), n=A.count(), biggest=A.biggest("score"))


@query("partition_by_locus_strand", f"""--with{_COARSE[1:]} select chrom, start, "end", '' as name, 0 as score, '.' as strand, i.strand as "group", count(*) as n from co i group by chrom, start, "end", i.strand""")
def _partition_strand(spark, d):
    return R.partition_r(coarse(intervals(spark, d)), group=F.col("strand"), n=A.count())


@query("project_extend", """select chrom, start + 5 as start, "end" + 5 as "end", name, score, strand, "end" - start as size, score * 2.0 as twice from iv where strand <> '-' and score > 10""")
def _project(spark, d):
    rows = R.select_r(intervals(spark, d), (F.col("score") > 10) & K.plus_strand(F.col("strand")))
    return R.extend_r(R.shift(R.project_r(rows, size=F.col("end") - F.col("start")), 5), twice=F.col("score") * 2.0)


@query("plus_minus_distinct", """select distinct chrom, start, "end", '+' as strand from iv where strand <> '-' union all select distinct chrom, start, "end", '-' from iv where strand <> '+'""")
def _plus_minus(spark, d):
    iv = intervals(spark, d).select("chrom", "start", "end", "strand")
    return R.union_r(R.plus(iv), R.minus(iv))


@query("end_points", """select chrom, start, start as "end" from iv union all select chrom, "end", "end" from iv""")
def _end_points(spark, d):
    iv = intervals(spark, d).select("chrom", "start", "end")
    return R.union_r(R.chrom_start(iv), R.chrom_end(iv))


@query("distinct_consecutive", """select event_id, event_type, props from (select *, lag(event_type) over w as t, lag(props) over w as p from (select event_id, event_type, user_id % 2 as props from events) window w as (order by event_id)) where t is null or t <> event_type or p <> props""", view=False)
def _distinct(spark, d):
    return R.distinct(read(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 2).alias("props")), "event_id")


@query("merged_with", """select chrom, start, "end", id from iv where sid = 'purchase' union all select chrom, start, "end", id from iv where sid = 'error' or sid = 'purchase'""")
def _merged(spark, d):
    key = ("chrom", "start", "end")
    a, b = (OrderedFrame(_track(spark, d, *s).select(*key, "id"), key) for s in (("purchase",), ("error", "purchase")))
    return a.merged_with(b).df


# Coverage.

_SIDES = """--with st as (select chrom, start, "end", unnest(case strand when '.' then ['+', '-'] else [strand] end) as strand from iv where sid in ('purchase', 'error', 'view')),
  pt as (select chrom, strand, p, sum(d) as d from (select chrom, strand, start as p, 1 as d from st where start < "end" union all select chrom, strand, "end", -1 from st where start < "end") group by all),
  dp as (select chrom, strand, p as start, lead(p) over w as "end", cast(sum(d) over w as bigint) as h from pt where d <> 0 window w as (partition by chrom, strand order by p)) """


def _cover_query(name, f, tail: str, **kw):
    def g(spark, d):
        out = f(_track(spark, d, "purchase", "error", "view"), **kw)
        return out.select("chrom", "start", "end", "strand", *(c for c in out.columns if c in ("htIndex", "accIndex", "average")))

    query(name, _SIDES + tail)(g)


_LINE = "(partition by chrom, strand order by start)"
_cover_query("histo", C.histo, 'select chrom, start, "end", strand, h as "htIndex" from dp where h >= 1', depth=C.at_least(1))
_cover_query("histo_between", C.histo, 'select chrom, start, "end", strand, h as "htIndex" from dp where h between 2 and 3', depth=C.between(2, 3))
_cover_query("cover_atleast2", C.cover, f""", isl as (select *, sum(n) over {_LINE} as k from (select *, case when lag("end") over {_LINE} = start then 0 else 1 end as n from dp where h >= 2))
  select chrom, min(start) as start, max("end") as "end", strand, arg_min(h, start) as "htIndex" from isl group by chrom, strand, k""", depth=C.at_least(2))
_cover_query("summit", C.summit, f"""select chrom, start, "end", strand, h as "htIndex" from (select *, case when lag("end") over {_LINE} = start then lag(h) over {_LINE} else 0 end as l,
  case when lead(start) over {_LINE} = "end" then lead(h) over {_LINE} else 0 end as r from dp where h >= 1) where h > l and h > r""", depth=C.at_least(1))
_cover_query("flat", C.flat, f""", hull as (select d.chrom, d.strand, d.h, d.start as s, min(st.start) as start, max(st."end") as "end" from dp d join st on st.chrom = d.chrom and st.strand = d.strand and st.start < d."end" and d.start < st."end" where d.h >= 2 group by all),
  isl as (select *, sum(n) over (partition by chrom, strand order by start, "end", s) as k from (select *, case when max("end") over (partition by chrom, strand order by start, "end", s rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as n from hull))
  select chrom, min(start) as start, max("end") as "end", strand, arg_min(h, (start, "end", s)) as "htIndex" from isl group by chrom, strand, k""", depth=C.at_least(2))
_cover_query("complement", C.complement, f'select chrom, "end" as start, n as "end", strand from (select *, lead(start) over {_LINE} as n from dp where h > 0) where n > "end"')
_cover_query("histo_aggregated", C.histo, """select d.chrom, d.start, d."end", d.strand, d.h as "htIndex", count(v.id) as "accIndex", round(avg(v.score), 6) as average
  from dp d join iv v on v.sid in ('purchase', 'error', 'view') and v.chrom = d.chrom and v.start < d."end" and d.start < v."end" and (v.strand = d.strand or v.strand = '.') where d.h >= 3 group by all""", depth=C.at_least(3), average=A.average("score").then(lambda c: F.round(c, 6)))
_cover_query("histo_unstranded", C.histo, 'select chrom, start, "end", \'.\' as strand, h as "htIndex" from (select chrom, p as start, lead(p) over (partition by chrom order by p) as "end", cast(sum(d) over (partition by chrom order by p) as bigint) as h from (select chrom, p, sum(d) as d from (select chrom, start as p, 1 as d from iv where sid in (\'purchase\', \'error\', \'view\') union all select chrom, "end", -1 from iv where sid in (\'purchase\', \'error\', \'view\')) group by all) where d <> 0) where h >= 1', depth=C.at_least(1), stranded=False)
_cover_query("cover_segments", C.segments, """, pts as (select distinct chrom, strand, p from (select chrom, strand, start as p from st union all select chrom, strand, "end" from st))
  select pts.chrom, p as start, min(st."end") as "end", pts.strand, count(*) as "htIndex" from pts join st on st.chrom = pts.chrom and st.strand = pts.strand and st.start <= p and p < st."end" group by pts.chrom, p, pts.strand""")


# Samples. Metadata: a cell and a factor for each event type.

_META = [("click", "k562", "ctcf"), ("error", "hepg2", "ctcf"), ("purchase", "k562", "pol2"), ("signup", "a549", "pol2"), ("view", "hepg2", "jund")]
_META_SQL = "--with sm(sid, cell, tf) as (values " + ", ".join(map(str, _META)) + ") "


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(spark.createDataFrame(_META, "sid string, cell string, tf string"), intervals(spark, sf_dir))


@query("select_s", _META_SQL + "select i.* from iv i join sm using (sid) where cell = 'k562'")
def _select_s(spark, d):
    out = dataset(spark, d).select_s(F.col("cell") == "k562").regions
    return out


@query("project_s", _META_SQL + "select sid, upper(cell) as line from sm")
def _project_s(spark, d):
    return dataset(spark, d).project_s(line=F.upper("cell")).samples


@query("extend_s", _META_SQL + "select sid, cell, tf, count(id) as n, round(coalesce(avg(score), 0), 6) as mean from sm left join iv using (sid) group by all")
def _extend_s(spark, d):
    return dataset(spark, d).extend_s(n=A.count("id"), mean=A.average("score").then(lambda c: F.round(c, 6))).samples


@query("groupby_s", _META_SQL + "select sid, cell, tf, count(*) over (partition by cell) as n, min(tf) over (partition by cell) as least from sm")
def _groupby_s(spark, d):
    return dataset(spark, d).group_s("cell", n=A.count(), least=A.smallest("tf")).samples


@query("semijoin_s", _META_SQL + "select * from sm s where exists (select 1 from sm t where t.cell = s.cell and t.tf <> s.tf)")
def _semijoin_s(spark, d):
    ds = dataset(spark, d)
    return ds.semijoin(ds, ("cell",), ("tf",)).samples


@query("difference_s", _META_SQL + f"""select u.* from iv u where u.sid in ('click', 'error', 'signup') and not exists (select 1 from iv v join sm t on t.sid = v.sid join sm s on s.sid = u.sid where t.tf in ('pol2', 'jund') and t.sid <> 'signup' and t.cell = s.cell and {_OVER} and {_STRAND})""")
def _difference_s(spark, d):
    ds = dataset(spark, d)
    return ds.select_s(F.col("sid").isin("click", "error", "signup")).difference_s(ds.select_s("tf in ('pol2', 'jund') and sid <> 'signup'"), ("cell",)).regions


_PAIRED = f"from iv u join sm s on s.sid = u.sid join sm t on t.cell = s.cell and t.tf <> 'ctcf' and s.tf = 'ctcf'"


@query("join_s", _META_SQL + f"select s.sid || '|' || t.sid as sid, u.id, v.id as r_id {_PAIRED} join iv v on v.sid = t.sid and {_OVER} and {_STRAND}")
def _join_s(spark, d):
    ds = dataset(spark, d)
    return ds.select_s("tf = 'ctcf'").join_s(ds.select_s("tf <> 'ctcf'"), ("cell",)).regions.select("sid", "id", "r_id")


@query("map_s", _META_SQL + f"select s.sid || '|' || t.sid as sid, u.id, count(v.id) as \"count\", coalesce(sum(v.score), 0) as total {_PAIRED} left join iv v on v.sid = t.sid and {_OVER} and {_STRAND} group by all")
def _map_s(spark, d):
    ds = dataset(spark, d)
    return ds.select_s("tf = 'ctcf'").map_s(ds.select_s("tf <> 'ctcf'"), ("cell",), total=A.total("score")).regions.select("sid", "id", "count", "total")


@query("cover_s", _META_SQL + """, pt as (select tf, chrom, p, sum(d) as d from (select tf, chrom, start as p, 1 as d from iv join sm using (sid) union all select tf, chrom, "end", -1 from iv join sm using (sid)) group by all),
  dp as (select tf as sid, chrom, p as start, lead(p) over w as "end", cast(sum(d) over w as bigint) as "htIndex" from pt where d <> 0 window w as (partition by tf, chrom order by p))
  select * from dp where "htIndex" >= 2""")
def _cover_s(spark, d):
    out = dataset(spark, d).cover_s(lambda df, by: C.histo(df, C.at_least(2), by, stranded=False), "tf").regions
    return out.select("sid", "chrom", "start", "end", "htIndex")


# Ordered collections, aggregates.


@query("price_competitors_dleq", """select p.p_partkey, count(q.p_partkey) as n, min(q.p_partkey) as first from part p left join part q on floor(abs(q.p_retailprice - p.p_retailprice)) <= 1 and q.p_brand <> p.p_brand and q.p_type = p.p_type group by all""", view=False)
def _competitors(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_type")
    us = OrderedFrame(p, ("p_retailprice",))
    out = us.join(us).fold(K.dleq(1), where=lambda: F.col("p_brand") != F.col("r_p_brand"), sees=("p_brand",), by=("p_type",), n=A.tally(), first=A.least("p_partkey"))
    return out.select("p_partkey", "n", "first")


@query("size_percent", """select a.s_suppkey, b.s_suppkey as r_s_suppkey from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal > 0 and b.s_acctbal > 0 and greatest(a.s_acctbal, b.s_acctbal) < least(a.s_acctbal, b.s_acctbal) * cast(1.2 as double)""", view=False)
def _size_percent(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return J.ratio_pairs(s, s, "s_acctbal", 1.2, by=("s_nationkey",)).select("s_suppkey", "r_s_suppkey")


@query("star_join", f"""select u.id, (select count(*) from iv v where v.sid = 'error' and {_OVER}) as errors, (select count(*) from iv v where v.sid = 'view' and {_SAME} and {_GAP} <= 10) as views from iv u where u.sid = 'purchase'""")
def _star(spark, d):
    us = _track(spark, d, "purchase").select("chrom", "start", "end", "id")
    near = lambda sid, p: J.folded(us, _track(spark, d, sid), p, folds={"n": A.tally()})
    return J.star(us, ("id",), errors=near("error", K.overlap(1)), views=near("view", K.near(10))).select("id", "errors", "views")


@query("anti_join", f"""select u.id from iv u where u.sid = 'purchase' and not exists (select 1 from iv v where v.sid = 'error' and {_SAME} and {_GAP} <= 30)""")
def _anti(spark, d):
    return J.without(_track(spark, d, "purchase"), _track(spark, d, "error"), K.near(30)).select("id")


@query("stats", """select l_returnflag, count(l_quantity) as "count", round(sum(l_quantity), 4) as "sum", round(sum(l_quantity * l_quantity), 4) as sumsq, min(l_quantity) as "min", max(l_quantity) as "max", round(avg(l_quantity), 6) as average, round(var_samp(l_quantity), 6) as variance from lineitem group by 1""", view=False)
def _stats(spark, d):
    out = read(spark, d, "lineitem").groupBy("l_returnflag").agg(A.stats("l_quantity").on().alias("s")).select("l_returnflag", "s.*")
    return out.withColumns({c: F.round(c, n) for c, n in (("sum", 4), ("sumsq", 4), ("average", 6), ("variance", 6))})


def _extreme(most):
    def g(spark, d):
        out = OrderedFrame(read(spark, d, "part"), ("p_brand",)).extremes("p_size", "p_partkey", most=most)
        return out.select("p_brand", "value", F.explode("rows.p_partkey").alias("p_partkey"))

    return g


_EXTREME = "select p_brand, p_size as value, p_partkey from (select *, rank() over (partition by p_brand order by p_size {0}) as k from part) where k = 1"
query("minimize", _EXTREME.format(""), view=False)(_extreme(False))
query("maximize", _EXTREME.format("desc"), view=False)(_extreme(True))


@query("aggregates", """select p_brand, count(*) as n, sum(p_size) as total, avg(p_size) as mean, min(p_size) as least, max(p_size) as most, bool_and(p_size > 1) as every, bool_or(p_size > 49) as some, round(exp(sum(ln(1.0 + p_size / 1000.0))), 6) as prod, sum(case when p_size > 25 then p_size else 0 end) as large, max(p_size) - min(p_size) as spread from part group by 1""", view=False)
def _aggregates(spark, d):
    size = F.col("p_size")
    large = A.total("p_size").keep(lambda c: c("p_size") > 25)
    return OrderedFrame(read(spark, d, "part"), ("p_brand",)).clustered_fold(
        n=A.count(), total=A.total("p_size"), mean=A.average("p_size"), least=A.smallest("p_size"), most=A.biggest("p_size"), every=A.forall(size > 1), some=A.exists(size > 49),
        prod=A.product(1.0 + size / 1000.0).then(lambda c: F.round(c, 6)), large=large, spread=A.combine(A.biggest("p_size"), A.smallest("p_size"), lambda a, b: a - b),
    )


@query("clustered", """select o_custkey, count(*) as n, sum(o_totalprice) as total, min(o_orderkey) as first from orders group by 1""", view=False)
def _clustered(spark, d):
    out = OrderedFrame(read(spark, d, "orders"), ("o_custkey",)).clustered("o_orderkey", "o_totalprice")
    return out.select("o_custkey", F.size("rows").cast("long").alias("n"), F.round(F.aggregate("rows.o_totalprice", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.col("rows")[0]["o_orderkey"].alias("first"))


ORACLE["clustered"] = ORACLE["clustered"].replace("sum(o_totalprice) as", "round(sum(o_totalprice), 4) as")


@query("runs", """select user_id, event_type, count(*) as n, min(event_id) as first from (select *, sum(x) over (partition by user_id order by event_id) as k from (select *, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as x from events)) group by user_id, event_type, k""", view=False)
def _runs(spark, d):
    return OrderedFrame(read(spark, d, "events"), ("event_type",)).runs("event_id", ("user_id",), n=A.count(), first=A.smallest("event_id"))


@query("sliding", """select event_id, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 4) as total, lead(event_id) over (partition by user_id order by event_id) as next from events""", view=False)
def _sliding(spark, d):
    o = OrderedFrame(read(spark, d, "events"), ("event_id",)).sliding(2, "value", by=("user_id",)).ahead("event_id", by=("user_id",))
    return o.df.select("event_id", F.round(F.aggregate("window.value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "next")


@query("top_and_nth", """(select event_id, 'top' as kind from events order by event_id limit 3) union all (select event_id, 'nth' from events order by event_id desc offset 4 limit 1)""", view=False)
def _top(spark, d):
    o = OrderedFrame(read(spark, d, "events").select("event_id"), ("event_id",))
    return o.take(3).withColumn("kind", F.lit("top")).union(o.reversed().nth(4).withColumn("kind", F.lit("nth")))


@query("distinct_keys", "select distinct l_suppkey, l_returnflag from lineitem", view=False)
def _keys(spark, d):
    return OrderedFrame(read(spark, d, "lineitem"), ("l_suppkey", "l_returnflag")).distinct_keys()


# Proteins: order lines as peptide matches, parts as proteins.

_DECOY = "case when p_brand in ('Brand#11', 'Brand#12', 'Brand#21') or p_partkey % 7 = 0 then 'DECOY' else 'P' end || l_partkey"
_PSM = f"""--with h as (select l_orderkey as pep, {_DECOY} as pro, min(l_discount * 9.9) as score, min(p_size) as len from lineitem join part on p_partkey = l_partkey where l_discount * 9.9 <= 0.999 group by 1, 2),
  n as (select pep, pro, score, 1.0 - (1.0 - score) * ((1.0 / len) / sum(1.0 / len) over (partition by pep)) as f from h),
  c as (select pro, acc as "accPEP", -10 * log10(acc + 1e-14) as conf, case when pro like 'DECOY%' then -1 else 1 end as label from (select pro, product(f) as acc from n group by 1)) """


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    name = F.concat(F.when(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21") | (F.col("p_partkey") % 7 == 0), "DECOY").otherwise("P"), F.col("p_partkey").cast("string"))
    rows = read(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    peptides = rows.select(F.col("l_orderkey").alias("pep"), (F.col("l_discount") * 9.9).alias("score"), F.array(F.struct(name.alias("accession"))).alias("hits"))
    return peptides, part.select(name.alias("pro"), F.col("p_size").alias("len"))


@query("psm_normalize", (f"with {_PSM} select pep, pro, round(score, 6) as score, round(f + 1e-10, 6) as \"falseProb\" from n").replace("--with", ""), view=False)
def _normalize(spark, d):
    peptides, proteins = _matches(spark, d)
    return X.normalized(X.selected(peptides), proteins).select("pep", "pro", F.round("score", 6).alias("score"), F.round(F.col("falseProb") + TIE, 6).alias("falseProb"))


@query("protein_scores", (f"with {_PSM} select pro, round(\"accPEP\" + 1e-10, 6) as \"accPEP\", round(conf + 1e-10, 4) as conf, label from c").replace("--with", ""), view=False)
def _scores(spark, d):
    peptides, proteins = _matches(spark, d)
    out = X.scored(X.normalized(X.selected(peptides), proteins))
    return out.select("pro", F.round(F.col("accPEP") + TIE, 6).alias("accPEP"), F.round(F.col("conf") + TIE, 4).alias("conf"), "label")


_FDR = """, k as (select *, round(conf + 1e-10, 4) as r from c), per as (select r, count(*) filter (label = -1) as d, count(*) filter (label = 1) as t from k group by 1),
  fd as (select r, (1.0 + sum(d) over (order by r desc)) / (1.0 + sum(t) over (order by r desc)) as fdr from per), q as (select r, fdr, least(1.0, min(fdr) over (order by r)) as qval from fd) """


@query("fdr_qvalue", (f"with {_PSM}{_FDR} select pro, round(q.fdr, 6) as fdr, round(q.qval, 6) as qval from k join q using (r)").replace("--with", ""), view=False)
def _fdr(spark, d):
    peptides, proteins = _matches(spark, d)
    calls = X.scored(X.normalized(X.selected(peptides), proteins)).withColumn("conf", F.round(F.col("conf") + TIE, 4))  # so both engines see the same ties
    return X.with_fdr(calls).select("pro", F.round("fdr", 6).alias("fdr"), F.round("qval", 6).alias("qval"))
