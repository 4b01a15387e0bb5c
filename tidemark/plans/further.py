"""More queries and their SQL: predicates between points, pairs at landmarks, metadata, order, aggregates, and inference with complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions import fields as N
from ..functions import predicates as K
from ..operators import joins as J
from ..operators import regions as R
from ..operators import samples as S
from ..operators.ordered import OrderedFrame
from ..session import cut_lineage
from . import proteins as X
from .catalog import TIE, _FDR, _GAP, _META_SQL, _OVER, _PSM, _SAME, _STRAND, _matches, _track, dataset, intervals, query, read

# Points: parts of one brand, by size.


def _parts(spark, d) -> OrderedFrame:
    return OrderedFrame(read(spark, d, "part").select("p_partkey", "p_size", "p_brand"), ("p_size",))


def _points(name: str, test: str, *preds: K.Pred):
    def f(spark, d):
        us = _parts(spark, d)
        return us.join(us).fold(*preds, by=("p_brand",), n=A.tally(), first=A.least("p_partkey")).select("p_partkey", "n", "first")

    query(name, f"select u.p_partkey, count(v.p_partkey) as n, min(v.p_partkey) as first from part u left join part v on v.p_brand = u.p_brand and {test} group by 1", view=False)(f)


_APART = "abs(v.p_size - u.p_size)"
_points("points_eq", "v.p_size = u.p_size", K.EQ)
_points("points_lteq_far", f"v.p_size <= u.p_size and {_APART} > 30", K.LTEQ, K.dg(30))
_points("points_lt", "v.p_size < u.p_size", K.LT)
_points("points_gt_near", f"v.p_size > u.p_size and {_APART} <= 3", K.dleq(3), K.GT)
_points("points_gteq_between", f"v.p_size >= u.p_size and {_APART} < 5 and {_APART} >= 2", K.dl(5), K.dgeq(2), K.GTEQ)
_points("points_ratio", "greatest(v.p_size, u.p_size) < least(v.p_size, u.p_size) * cast(1.1 as double)", K.szpercent(1.1))


@query("strings_eq_length", """select u.p_partkey, count(v.p_partkey) as n from part u left join (select p_partkey, p_type, p_brand from part where p_partkey % 2 = 0) v on v.p_type = u.p_type and v.p_brand <> u.p_brand
  and greatest(length(v.p_type), length(u.p_type)) < least(length(v.p_type), length(u.p_type)) * 1.5 group by 1""", view=False)
def _strings(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    us, vs = (OrderedFrame(x, ("p_type",)) for x in (p, p.where("p_partkey % 2 = 0")))
    return us.join(vs).fold(K.EQ, K.szpercent(1.5, F.length), where=lambda: F.col("p_brand") != F.col("r_p_brand"), sees=("p_brand",), n=A.tally()).select("p_partkey", "n")


@query("join_first_n", """select p_partkey, m from (select u.p_partkey, v.p_partkey as m, row_number() over (partition by u.p_partkey order by v.p_partkey) as k from part u join part v on v.p_brand = u.p_brand and abs(v.p_size - u.p_size) <= 2) where k <= 3""", view=False)
def _first(spark, d):
    us = _parts(spark, d)
    return us.join(us).on(K.dleq(2), names=("p_partkey",), by=("p_brand",), first=3).select("p_partkey", F.explode("matches.p_partkey").alias("m"))


@query("join_using", """select u.p_partkey, count(v.p_partkey) as n from part u left join part v on v.p_brand = u.p_brand and v.p_size * 2 >= u.p_size and v.p_size <= u.p_size group by 1""", view=False)
def _using(spark, d):
    us = _parts(spark, d)
    return us.join(us).using(lambda v, u: (v.start * 2 >= u.start) & (v.start <= u.start), sees=(), folds={"n": A.tally()}, by=("p_brand",)).select("p_partkey", "n")


@query("interval_keys", f"""select u.id, count(v.id) as n from iv u left join iv v on v.sid = 'error' and {_OVER} where u.sid = 'purchase' group by 1""")
def _interval_keys(spark, d):
    us, vs = (OrderedFrame(_track(spark, d, s).select("chrom", "start", "end", "id"), ("start", "end")) for s in ("purchase", "error"))
    return us.join(vs).fold(K.overlap(1), by=("chrom",), n=A.tally()).select("id", "n")


# Loci.


def _counts(name: str, test: str, *preds: K.Pred):
    def f(spark, d):
        return J.folded(_track(spark, d, "purchase").select("chrom", "start", "end", "id"), _track(spark, d, "error"), *preds, folds={"n": A.tally()})

    query(name, f"""select u.chrom, u.start, u."end", u.id, count(v.id) as n from iv u left join iv v on v.sid = 'error' and {_SAME} and {test} where u.sid = 'purchase' group by all""")(f)


_counts("count_is_before", '(v.start < u.start or (v.start = u.start and v."end" < u."end"))', K.IS_BEFORE)
_counts("count_start_before", "v.start < u.start", K.START_BEFORE)
_counts("count_outside_near", f"{_GAP} <= 80 and {_GAP} > 0", K.near(80), K.OUTSIDE)
_counts("count_end_after_near", f'{_GAP} <= 80 and v."end" > u."end"', K.near(80), K.END_AFTER)
_counts("count_starts_near", "abs(v.start - u.start) <= 40", K.based_on_start(K.near(40)))
_counts("count_ends_near", 'abs(v."end" - u."end") <= 40', K.based_on_end(K.near(40)))
_counts("count_not_before", f"{_GAP} <= 60 and not v.start < u.start", K.near(60), ~K.START_BEFORE)
_counts("count_either", f"({_GAP} <= 10 or abs(v.start - u.start) <= 50)", K.near(10) | K.based_on_start(K.near(50)))


@query("landmark_pairs", f"""--with s as (select *, case sid when 'click' then 'ctcf' when 'view' then 'jund' when 'signup' then 'ctcf' else 'pol2' end as tf from iv where sid in ('click', 'view', 'signup'))
  select g.id, a.id as u_id, b.id as v_id, least(a.start, b.start) as start, greatest(a."end", b."end") as "end" from iv g
  join s a on a.chrom = g.chrom and greatest(a.start - g."end", g.start - a."end", 0) <= 20 join s b on b.chrom = g.chrom and greatest(b.start - g."end", g.start - b."end", 0) <= 20
  where g.sid = 'error' and a.tf < b.tf and abs(a.start - b.start) <= 30""")
def _landmarks(spark, d):
    marks = _track(spark, d, "error").select("chrom", "start", "end", "id")
    tf = F.when(F.col("sid") == "click", "ctcf").when(F.col("sid") == "view", "jund").when(F.col("sid") == "signup", "ctcf")
    rows = intervals(spark, d).where("sid in ('click', 'view', 'signup')").select("chrom", "start", "end", "id", tf.alias("tf"))
    out = J.landmark_pairs(marks, rows, rows, K.near(20), K.based_on_start(K.near(30)), key=("id",), where=F.col("u_tf") < F.col("v_tf"))
    return out.select("id", "u_id", "v_id", F.least("u_start", "v_start").alias("start"), F.greatest("u_end", "v_end").alias("end"))


@query("join_custom_output", f"""select u.id, v.id as other, v.start - u.start as moved from iv u join iv v on {_OVER} and {_STRAND} where u.sid = 'purchase' and v.sid = 'view' and v.score > u.score""")
def _custom(spark, d):
    out = lambda fixed, um, vm: ([F.col("id"), F.col("r_id").alias("other"), (F.col("r_start") - F.col("start")).alias("moved")], F.col("r_score") > F.col("score"))
    return R.join_r(_track(spark, d, "purchase"), _track(spark, d, "view"), K.overlap(1), output=out)


@query("sort_distinct_null_strand", """select distinct chrom, start, "end", '.' as strand from iv where sid in ('purchase', 'error')""")
def _sort_distinct(spark, d):
    rows = _track(spark, d, "purchase", "error").select("chrom", "start", "end", "strand")
    return R.sort_distinct(R.null_strand(R.union_r(rows, rows.limit(0), rows)))


# Samples.


@query("track_sizes", _META_SQL + "select sid, count(id) as track_size from sm left join iv using (sid) group by 1")
def _track_sizes(spark, d):
    return dataset(spark, d).track_sizes()


@query("sample_metadata", _META_SQL + "select sid, coalesce(nullif(cell, 'a549'), 'HELA') as cell_line, 'human' as organism from sm")
def _metadata(spark, d):
    ds = dataset(spark, d).extend_s(cell=F.nullif("cell", F.lit("a549")))
    return ds.merge_meta(cell=F.lit("HELA"), organism=F.lit("human")).rename_meta(cell="cell_line").delete_meta("tf").samples


@query("merge_track", _META_SQL + """select sid, chrom, start, "end", id from iv union all select sid, chrom, start, "end", id from iv where sid = 'error'""")
def _merge_track(spark, d):
    ds = dataset(spark, d)
    return ds.merge_track(ds.regions.where("sid = 'error'")).delete_track_meta("name", "score", "strand").sorted().regions.select("sid", "chrom", "start", "end", "id")


@query("on_region", _META_SQL + """select sid, chrom, start + 7 as start, "end" + 7 as "end", id from iv where score > 100""")
def _on_region(spark, d):
    return dataset(spark, d).on_region(lambda df: R.shift(df.where("score > 100"), 7)).regions.select("sid", "chrom", "start", "end", "id")


_PARTIAL = [("a", "x", "p"), ("b", None, "p"), ("c", "x", None), ("d", "x", "q"), ("e", "y", None), ("f", None, None)]


@query("semijoin_missing", "with s(sid, cell, tf) as (values ('a', 'x', 'p'), ('b', null, 'p'), ('c', 'x', null), ('d', 'x', 'q'), ('e', 'y', null), ('f', null, null)) select sid from s where exists (select 1 from s t where t.cell = s.cell and (t.tf is null or t.tf <> s.tf))", view=False)
def _semijoin_missing(spark, d):
    s = spark.createDataFrame(_PARTIAL, "sid string, cell string, tf string")
    ds = S.Dataset(s, intervals(spark, d))
    return ds.semijoin(ds, ("cell",), ("tf",)).samples.select("sid")


@query("cover_missing_keys", """with m(sid, cell, tf) as (values ('click', 'x', null), ('error', null, 'x'), ('purchase', 'x|y', 'z'), ('signup', 'x', 'y|z'), ('view', 'x', null)),
  iv as (select 'u' || lpad(cast(user_id % 25 as varchar), 2, '0') as chrom, cast(floor(epoch(ts) / 60) as int) - 28401120 as start, cast(floor(epoch(ts) / 60) as int) - 28401119 + cast(floor(value) as int) as "end", event_type as sid from events),
  pt as (select cell, tf, chrom, p, sum(d) as d from (select cell, tf, chrom, start as p, 1 as d from iv join m using (sid) union all select cell, tf, chrom, "end", -1 from iv join m using (sid)) group by all),
  dp as (select cell, tf, chrom, p as start, lead(p) over w as "end", cast(sum(d) over w as bigint) as h from pt where d <> 0 window w as (partition by cell, tf, chrom order by p))
  select cell, tf, count(*) as n, sum(("end" - start) * h) as area from dp where h >= 1 group by all""", view=False)
def _cover_missing(spark, d):
    s = spark.createDataFrame([("click", "x", None), ("error", None, "x"), ("purchase", "x|y", "z"), ("signup", "x", "y|z"), ("view", "x", None)], "sid string, cell string, tf string")
    from ..operators import coverage as C

    out = S.Dataset(s, intervals(spark, d)).cover_s(lambda df, by: C.histo(df, C.at_least(1), by, stranded=False), "cell", "tf")
    sums = out.extend_s(n=A.count("chrom"), area=A.Agg(lambda c: F.sum((c("end") - c("start")) * c("htIndex"))))
    return sums.samples.select("cell", "tf", "n", "area")


def _meta_query(name: str, cols: str, on_sample) -> None:
    def f(spark, d):
        ds = dataset(spark, d)
        return ds.select_s("tf = 'ctcf'").join_s(ds.select_s("tf <> 'ctcf'"), ("cell",), on_sample=on_sample).samples

    query(name, _META_SQL + f"select s.sid || '|' || t.sid as sid, {cols} from sm s join sm t on t.cell = s.cell where s.tf = 'ctcf' and t.tf <> 'ctcf'")(f)


_meta_query("join_s_left", "s.cell, s.tf", S.keep_left)
_meta_query("join_s_right", "t.cell, t.tf", S.keep_right)
_meta_query("join_s_both", "s.cell, s.tf, t.cell as r_cell, t.tf as r_tf", None)
_meta_query("join_s_overwrite", "t.cell, s.tf, t.tf as other_tf", S.overwrite(lambda n: "cell" if n == "cell" else "other_" + n))


# Order, aggregates, scalar functions.


@query("orderedness", "select true as by_id, false as by_value, true as same, false as other", view=False)
def _orderedness(spark, d):
    e = read(spark, d, "events").select("event_id", "value")
    by_id, by_value = OrderedFrame(e, ("event_id",)), OrderedFrame(e, ("value",))
    same, other = by_id.same_rows(by_value.sorted_if_needed("event_id")), by_id.same_rows(by_id.filter("value > 1"))
    return spark.createDataFrame([(by_id.is_ordered("event_id"), by_value.is_ordered("event_id"), same, other)], "by_id boolean, by_value boolean, same boolean, other boolean")


@query("exploded_steps", """select o_orderkey, unnest([1, 2, 3]) * o_custkey as step from orders where o_orderstatus = 'F'""", view=False)
def _steps(spark, d):
    o = OrderedFrame(read(spark, d, "orders"), ("o_orderkey",)).filter("o_orderstatus = 'F'")
    return o.extend(ks=F.array(F.lit(1), F.lit(2), F.lit(3))).explode("ks", "k").select("o_orderkey", (F.col("k") * F.col("o_custkey")).alias("step")).df


@query("drop_and_take", "(select event_id from events order by event_id desc limit 5) union all (select event_id from events order by event_id offset (select count(*) - 4 from events))", view=False)
def _drop(spark, d):
    o = OrderedFrame(read(spark, d, "events").select("event_id"), ("event_id",))
    return o.reversed().take(5).union(o.drop(o.count() - 4))


@query("aggregates_more", """select p_brand, count(*) as n, sum(p_size) as total, list(p_size * 2 order by p_size * 2)[1] as least2, len(list(p_size)) as listed, len(flatten(list([p_size, 1]))) as flat, max(p_size) + min(p_size) + count(*) as mixed, histogram(p_size)[7] as sevens from part group by 1""", view=False)
def _aggregates_more(spark, d):
    o = OrderedFrame(read(spark, d, "part"), ("p_brand",))
    out = o.clustered_fold(
        s=A.several(n=A.count(), total=A.total("p_size")), doubled=A.mapped(F.col("p_size") * 2), flat=A.flattened(F.array("p_size", F.lit(1))), kept=A.with_rows(A.count(), "p_size"),
        mixed=A.combine_n(lambda a, b, c: a + b + c, A.biggest("p_size"), A.smallest("p_size"), A.count()),
    )
    out = out.join(o.histogram("p_size"), "p_brand")
    return out.select("p_brand", "s.n", "s.total", F.col("doubled")[0].alias("least2"), F.size("kept.rows").cast("long").alias("listed"), F.size("flat").cast("long").alias("flat"), "mixed", F.col("histogram")[7].alias("sevens"))


@query("grouped_extremes", f"""select u.id, min(v.score) as least, count(*) filter (v.score = m.s) as n from iv u join (select u.id, min(v.score) as s from iv u join iv v on v.sid = 'view' and {_OVER} where u.sid = 'error' group by 1) m using (id)
  join iv v on v.sid = 'view' and {_OVER} where u.sid = 'error' group by 1""")
def _grouped_extremes(spark, d):
    out = J.extremes(_track(spark, d, "error").select("chrom", "start", "end", "id"), _track(spark, d, "view"), K.overlap(1), x="score", folds={"n": A.tally()}, into="least")
    return out.select("id", "least", "n")


@query("scalar_functions", """select p_partkey, 'A' || p_partkey as bare, case when p_partkey % 2 = 0 then 'P' || p_partkey else 'Q' end as uniprot, split_part(p_name, ' ', 1) as protein, length(p_name) as len, case when p_brand = 'Brand#11' then -1 else 1 end as label,
  case p_partkey % 3 when 0 then 'Int' when 1 then 'Double' else 'String' end as kind, round(-10 * log10(p_retailprice / 10000 + 1e-14) + 1e-10, 6) as conf from part""", view=False)
def _scalars(spark, d):
    p = read(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    tagged = F.concat(F.lit(".(Acetyl)A(Oxidation)"), key, F.lit("(Carbamidomethyl)"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sp|P"), key, F.lit("|X"))).otherwise("Q")
    brand = F.when(F.col("p_brand") == "Brand#11", "DECOY1").otherwise("P1")
    text = F.when(F.col("p_partkey") % 3 == 0, "12").when(F.col("p_partkey") % 3 == 1, "1.5").otherwise("x1")
    return p.select("p_partkey", N.bare_sequence(tagged).alias("bare"), N.uniprot(name).alias("uniprot"), N.protein_name(F.col("p_name")).alias("protein"), F.length("p_name").cast("long").alias("len"), N.label(brand).alias("label"), N.sniffed(text).alias("kind"), F.round(N.confidence(F.col("p_retailprice") / 10000) + TIE, 6).alias("conf"))


# Inference with complexes: what a supplier delivers is a complex; suppliers of even nations are human.

_CPX = """, cx as (select distinct l_suppkey as "cpxId", 'P' || l_partkey as pro from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey % 2 = 0 and l_linenumber = 1) """
_NAME = "regexp_replace(pro, '^(DECOY|P)', 'P')"


def _annotated_sql(calls: str, out: str) -> str:
    return f""", {out}_l as (select {_NAME} as name, min("accPEP") filter (label = 1) as t, min("accPEP") filter (label = -1) as d from {calls} group by 1),
  {out}_m as (select "cpxId", pro, coalesce(avg(case when t < 1 then t end) over (partition by "cpxId"), 1.0) as "targetProb", coalesce(avg(case when d < 1 then d end) over (partition by "cpxId"), 1.0) as "decoyProb" from cx left join {out}_l on name = pro) """


def _refined_sql(calls: str, out: str) -> str:
    return _annotated_sql(calls, out) + f""", {out}_b as (select pro as name, min("targetProb") as t, min("decoyProb") as d from {out}_m group by 1),
  {out} as (select pro, least("accPEP", coalesce(case when label = 1 then t else d end, "accPEP")) as "accPEP", label from {calls} left join {out}_b on name = {_NAME}) """


_ROUNDED = 'round("accPEP" + 1e-10, 6) as "accPEP"'


def _complexes(spark, d) -> DataFrame:
    l, s = read(spark, d, "lineitem").where("l_linenumber = 1"), read(spark, d, "supplier")
    rows = l.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_suppkey").alias("complexID"), F.when(F.col("s_nationkey") % 2 == 0, "Human").otherwise("Mouse").alias("organism"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("uniprotID"))
    return X.complexes(rows.groupBy("complexID", "organism").agg(F.collect_list(F.struct("uniprotID")).alias("subunits")))


def _target(c):
    return F.regexp_replace(c, "^(DECOY|P)", "P")


def _calls(spark, d) -> DataFrame:
    """Calls; confidences are rounded, so both engines see the same ties."""
    peptides, proteins = _matches(spark, d)
    return X.scored(X.normalized(X.selected(peptides), proteins)).withColumn("conf", F.round(F.col("conf") + TIE, 4))


@query("complexes", (f"with {_CPX[1:]} select * from cx"), view=False)
def _complex_query(spark, d):
    return _complexes(spark, d)


@query("complex_probabilities", (f"with {_PSM}{_CPX}{_annotated_sql('c', 'r')} select \"cpxId\", pro, round(\"targetProb\" + 1e-10, 6) as \"targetProb\", round(\"decoyProb\" + 1e-10, 6) as \"decoyProb\" from r_m").replace("--with", ""), view=False)
def _probabilities(spark, d):
    calls = _calls(spark, d)
    out = X.annotated(_complexes(spark, d), calls.select(_target(F.col("pro")).alias("pro"), "accPEP", "label"))
    return out.select("cpxId", "pro", *(F.round(F.col(c) + TIE, 6).alias(c) for c in ("targetProb", "decoyProb")))


@query("complex_refined", (f"with {_PSM}{_CPX}{_refined_sql('c', 'r')} select pro, {_ROUNDED}, label from r").replace("--with", ""), view=False)
def _refined(spark, d):
    out = X.refined(_calls(spark, d), _complexes(spark, d), _target)
    return out.select("pro", F.round(F.col("accPEP") + TIE, 6).alias("accPEP"), "label")


#: Calls are those of the rounded probabilities, so both engines call the same.
_CALLED = _FDR.replace("from c)", "from {0})").replace(" k as", " {1}k as").replace(" per as", " {1}per as").replace(" fd as", " {1}fd as").replace(" q as", " {1}q as").replace("from k ", "from {1}k ").replace("from per)", "from {1}per)").replace("from fd)", "from {1}fd)")


def _called(calls: DataFrame) -> DataFrame:
    conf = F.round(N.confidence(F.col("accPEP")) + TIE, 4)
    return X.with_fdr(calls.select("pro", "accPEP", conf.alias("conf"), "label"))


def _called_sql(calls: str, out: str) -> str:
    conf = f'(select pro, "accPEP", -10 * log10("accPEP" + 1e-14) as conf, label from {calls})'
    return _CALLED.format(conf, out)


#: Two levels, between which complexes make a difference.
_LEVELS = (0.328, 0.33)
_SIDES = " union all ".join(f"""select {n} as level, 'both' as side, pro from a join b using (pro) where a.q < {n} and b.q < {n}
  union all select {n}, 'cpx', pro from a where q < {n} and pro not in (select pro from b where q < {n}) union all select {n}, 'nocpx', pro from b where q < {n} and pro not in (select pro from a where q < {n})""" for n in _LEVELS)


@query("complex_analysis", (f"""with {_PSM}{_CPX}{_refined_sql('c', 'r')}{_called_sql('r', 'x')}{_called_sql('c', 'y')},
  a as (select pro, round(qval, 10) as q from xk join xq using (r) where label = 1), b as (select pro, round(qval, 10) as q from yk join yq using (r) where label = 1)
  select level::double as level, side, pro from ({_SIDES})""").replace("--with", ""), view=False)
def _analysis(spark, d):
    calls = cut_lineage(_calls(spark, d))
    cpx, nocpx = (cut_lineage(_called(c).withColumn("qval", F.round("qval", 10))) for c in (X.refined(calls, _complexes(spark, d), _target), calls))
    rows = []
    for level in _LEVELS:
        out = X.analysis(cpx, nocpx, level)
        sides = {"both": out["cpx"].join(out["nocpx"].select("pro"), "pro"), "cpx": out["cpx_only"], "nocpx": out["nocpx_only"]}
        rows += [df.select(F.lit(level).alias("level"), F.lit(n).alias("side"), "pro") for n, df in sides.items()]
    return R.union_r(*rows)


@query("complex_iterated", (f"with {_PSM}{_CPX}{_refined_sql('c', 'r')}{_refined_sql('r', 's')}{_refined_sql('s', 't')} select pro, {_ROUNDED}, label from t").replace("--with", ""), view=False)
def _iterated(spark, d):
    """Three rounds; with so low a number of new calls it never stops before."""
    peptides, proteins = _matches(spark, d)
    out = X.iterated(peptides, proteins, _complexes(spark, d), name=_target, rounds=3, fewest=-(10**9))
    return out.select("pro", F.round(F.col("accPEP") + TIE, 6).alias("accPEP"), "label")
