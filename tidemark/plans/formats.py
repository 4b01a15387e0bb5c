"""Queries of sources and sinks: tables written in a format to the shared folder and read back. SQL gives what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import Dataset
from ..session import shared_folder
from ..sources import text as T
from .catalog import _META, _META_SQL, intervals, query, read


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/formats-{uuid.uuid4().hex}/{name}"


_BED = ["chrom", "start", "end", "name", "score", "strand"]
_BED_SQL = 'chrom, start, "end", name, score, strand'


def _text(*cols) -> F.Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols)).alias("value")


@query("bed_round_trip", f"select {_BED_SQL}, cast(id as int) as id, sid from iv")
def _bed(spark, d):
    path = _path(spark, "iv.bed")
    T.write_bed(intervals(spark, d), path)
    return T.read_bed(spark, path)


@query("bed_skipped_lines", f"select {_BED_SQL} from iv where id % 5 > 2")
def _bed_skipped(spark, d):
    """Comments, browser and track lines, lines with too few fields and scores that are no whole numbers are skipped."""
    path, e = _path(spark, "iv.bed"), intervals(spark, d)
    k = F.col("id") % 5
    line = F.when(k == 0, F.concat(F.lit("#"), _text(*_BED))).when(k == 1, F.concat(F.lit("track "), _text(*_BED))).when(k == 2, F.when(F.col("id") % 2 == 0, _text(*_BED[:4])).otherwise(_text(*_BED[:4], F.lit("x"), "strand"))).otherwise(_text(*_BED))
    e.select(line).write.text(path)
    return T.read_bed(spark, path, [])


@query("narrow_peak", f"select {_BED_SQL}, score / 4 as signalval, score / 8 as pval, 0.5 as qval, score as peak from iv")
def _narrow(spark, d):
    path = _path(spark, "iv.narrowPeak")
    intervals(spark, d).select(_text(*_BED, F.col("score") / 4, F.col("score") / 8, F.lit(0.5), "score")).write.text(path)
    return T.read_narrow_peak(spark, path)


@query("tsv_round_trip", "select cast(p_partkey as int) as p_partkey, p_name, p_size, p_retailprice, p_size > 25 as large from part", view=False)
def _tsv(spark, d):
    path = _path(spark, "part.tsv")
    T.write_tsv(read(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large")), path)
    return T.read_tsv(spark, path)


@query("guarded_lines", "select cast(event_id as int) as id, event_type as kind, value from events where event_type <> 'view'", view=False)
def _guarded(spark, d):
    path = _path(spark, "lines")
    e = read(spark, d, "events")
    e.select(F.concat(F.lit("  "), F.when(F.col("event_type") == "view", ";").otherwise(""), _text("event_id", "event_type", "value"), F.lit(" "))).write.text(path)
    return T.ordered_file(spark, path, ("id",), [("id", "int"), ("kind", "string"), ("value", "double")], ~F.col("line").startswith(";")).df


@query("ordered_file_top", "select cast(event_id as int) as id from events order by event_id desc limit 7", view=False)
def _ordered_file(spark, d):
    path = _path(spark, "ids")
    T.write_lines(read(spark, d, "events"), path, "event_id")
    return T.ordered_file(spark, path, ("id",), [("id", "int")]).reversed().take(7)


@query("one_file", "select cast(count(*) as int) as n, true as counted from part", view=False)
def _one_file(spark, d):
    path = _path(spark, "part.txt")
    T.write_file(read(spark, d, "part").select("p_name"), path)
    n, total = spark.read.text(path).count(), read(spark, d, "part").select(F.sum(F.octet_length("p_name") + 1)).first()[0]
    return spark.createDataFrame([(n, T.size_on_disk(spark, path) == total)], "n int, counted boolean")


@query("saved_and_renamed", "select s_suppkey, s_name, s_acctbal from supplier", view=False)
def _saved(spark, d):
    path = _path(spark, "supplier")
    T.saved_as(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return T.renamed(spark, path, f"{path}2")


@query("fasta_round_trip", "select 'P' || p_partkey as name, repeat(upper(replace(p_type, ' ', '')), 9) as seq, p_brand as brand from part", view=False)
def _fasta(spark, d):
    path = _path(spark, "part.fasta")
    seq = F.repeat(F.upper(F.replace("p_type", F.lit(" "), F.lit(""))), 9)
    T.write_fasta(read(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.array("p_brand", F.lit("x")).alias("misc"), seq.alias("seq")), path)
    return T.read_fasta(spark, path).where("seq <> ''").select("name", "seq", F.col("misc")[0].alias("brand"))


def _run(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run file: lines of orders as matches with one hit for each of two parts, parts as proteins."""
    rows = read(spark, d, "lineitem").where("l_linenumber = 1")
    none = F.lit(None).cast("string")
    made = {"rt": F.col("l_quantity"), "mz": F.col("l_tax"), "score": F.col("l_discount"), "rank": F.lit(1), "sequence": F.concat(F.lit("A(Oxidation)"), "l_shipmode" if "l_shipmode" in rows.columns else "l_returnflag", F.col("l_orderkey").cast("string")), "charge": F.col("l_linenumber")}
    hit = lambda n, at: F.struct(F.concat(F.lit("P"), (F.col("l_partkey") + n).cast("string")).alias("accession"), F.lit(at).alias("start"), F.lit(at + 9).alias("end"))
    rest = {c: none for c in ("aa_before", "aa_after", "score_type", "search_id")} | {"predicted_rt": F.lit(3), "predicted_pt": F.lit(4)}
    peptides = rows.select(*((made | rest)[c].alias(c) for c, _ in T.PSM[1:] if c in made or c in rest), F.array(hit(0, 1), hit(1, 20)).alias("hits"))
    p = read(spark, d, "part")
    proteins = p.select((F.col("p_retailprice") / 1000).alias("score"), F.col("p_size").alias("rank"), F.concat(F.lit("P"), "p_partkey").alias("accession"), F.col("p_name").alias("description"), F.lit(0.5).alias("coverage"), F.col("p_type").alias("sequence"), F.when(F.col("p_size") > 25, "target").otherwise("decoy").alias("target_decoy"))
    run = spark.createDataFrame([("r1", "PEP", "false", "2024", "1.0", "none")], ", ".join(f"{c} string" for c, _ in T.RUN[1:]))
    path = _path(spark, "run.txt")
    T.write_run(run, peptides, proteins, path)
    return T.read_run(spark, path)


@query("peptides_round_trip", """select l_quantity as rt, l_tax as mz, l_discount as score, cast(l_linenumber as int) as charge, 'A' || l_returnflag || l_orderkey as pep, 'P' || (l_partkey + n) as accession, 1 + 19 * n as "start", 10 + 19 * n as "end"
  from lineitem, (values (0), (1)) as k(n) where l_linenumber = 1""", view=False)
def _peptides(spark, d):
    out = _run(spark, d)[1]
    return out.select("rt", "mz", "score", "charge", "pep", F.explode("hits").alias("h")).select("rt", "mz", "score", "charge", "pep", "h.accession", "h.start", "h.end")


@query("proteins_round_trip", "select p_retailprice / 1000 as score, p_size as rank, 'P' || p_partkey as accession, p_name as description, cast(0.5 as double) as coverage, p_type as sequence, case when p_size > 25 then 'target' else 'decoy' end as target_decoy from part", view=False)
def _proteins(spark, d):
    return _run(spark, d)[2]


@query("run_line", "select 'r1' as run_id, 'PEP' as score_type, 'false' as score_direction, '2024' as date_time, '1.0' as engine_version, 'none' as parameters", view=False)
def _run_line(spark, d):
    return _run(spark, d)[0]


@query("complexes_file", """select cast(s_suppkey as int) as "complexID", s_name as "complexName", 's' || s_suppkey as synonyms, 'm' || s_suppkey as "subunitsComment", cast(s_nationkey as int) as "pubMedID", 'o' || s_suppkey as "swissprotOrganism",
  n as k, case n when 1 then 'A' || s_suppkey else 'B' end as "uniprotID", case n when 1 then 'e' else '' end as "entrezID", case n when 1 then 'g1' else 'g2' end as "geneName", case n when 1 then 'y' || s_suppkey else '' end as "geneSynonyms", case n when 1 then 'p1' else 'p' || s_suppkey end as "proteinName",
  2 as gos from supplier, (values (1), (2)) as v(n)""", view=False)
def _complexes(spark, d):
    path, k = _path(spark, "complexes.txt"), F.col("s_suppkey").cast("string")
    tag = lambda x: F.concat(F.lit(x), k)
    fields = {"complexID": k, "complexName": F.col("s_name"), "organism": F.lit("Human"), "synonyms": tag("s"), "subunitsUniProt": F.concat(tag("A"), F.lit(";B")), "subunitsEntrez": F.lit("e"), "goID": F.lit("1;2"), "goDescription": F.lit("a;b;c"), "subunitsGeneName": F.lit("g1;g2"), "subunitsComment": tag("m"), "pubMedID": F.col("s_nationkey"), "swissprotOrganism": tag("o"), "subunitsGeneSynonyms": tag("y"), "subunitsProteinName": F.concat(F.lit("p1;"), tag("p"))}
    rows = read(spark, d, "supplier").select(_text(*(fields.get(c, F.lit("-")) for c in T.CORUM)))
    spark.createDataFrame([("\t".join(T.CORUM),)], "value string").union(rows).write.text(path)
    out = T.read_corum(spark, path)
    names = ("complexID", "complexName", "synonyms", "subunitsComment", "pubMedID", "swissprotOrganism")
    return out.select(*names, F.size("go").alias("gos"), F.posexplode("subunits").alias("k", "u")).select(*names, "gos", (F.col("k") + 1).alias("k"), "u.uniprotID", "u.entrezID", "u.geneName", "u.geneSynonyms", "u.proteinName")


def _samples(spark, d) -> Dataset:
    meta = spark.createDataFrame([(*m, i, i + 0.5) for i, m in enumerate(_META)], "sid string, cell string, tf string, n int, x double")
    return Dataset(meta, intervals(spark, d).select("sid", *_BED))


def _per_sample(ds: Dataset) -> DataFrame:
    rows = ds.regions.groupBy("sid").agg(F.count(F.lit(1)).alias("rows"), F.sum("start").alias("starts"), F.sum("score").alias("scores"), F.min("name").alias("name"))
    return ds.samples.select("sid", "cell", "tf", "n", "x").join(rows, "sid")


_PER = _META_SQL + "select sid, cell, tf, cast(row_number() over (order by sid) - 1 as int) as n, row_number() over (order by sid) - 0.5 as x, rows, starts, scores, name from sm join (select sid, count(*) as rows, sum(start) as starts, sum(score) as scores, min(name) as name from iv group by 1) using (sid)"


@query("sample_folder", _PER)
def _sample_folder(spark, d):
    path = _path(spark, "samples")
    T.write_sample_folder(_samples(spark, d), path)
    return _per_sample(T.open_samples(spark, f"{path}-list", path))


@query("sample_text", _PER)
def _sample_text(spark, d):
    path = _path(spark, "samples.txt")
    T.write_sample_text(_samples(spark, d), path)
    return _per_sample(T.open_samples(spark, path))


@query("sample_tables", _PER)
def _sample_tables(spark, d):
    path = _path(spark, "samples")
    T.write_samples(_samples(spark, d), path)
    return _per_sample(T.load_samples(spark, path))
