import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggs as A
from tidemark.operators import regions as R
from tidemark.operators.samples import Dataset
from tidemark.plans import proteins as X
from tidemark.sources import text as S
from tidemark.streaming.incremental import map_stream, totals


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n#c\nchr1\t1\t5\tn\t3\t+\nchr10\t2\t9\t.\t0\t.\nbad\t1\n\nbrowser y\nchr2\t1\t2\tm\tx\t-\n")
    got = S.read_bed(spark, str(tmp_path / "a.bed"))
    assert rows(got) == [("chr1", 1, 5, "n", 3, "+"), ("chr10", 2, 9, ".", 0, ".")]
    more = got.withColumn("qval", F.lit(0.5)).withColumn("peak", F.lit(7))
    S.write_bed(more, str(tmp_path / "out"))
    back = S.read_bed(spark, str(tmp_path / "out"))
    assert back.columns == [*got.columns, "peak", "qval"] and rows(back) == rows(more.select(back.columns))
    (tmp_path / "n.bed").write_text("chr1\t1\t5\tn\t3\t+\t1.5\t2.5\t0.1\t4\n")
    assert rows(S.read_narrow_peak(spark, str(tmp_path / "n.bed")))[0][6:] == (1.5, 2.5, 0.1, 4)
    assert S.empty_bed(spark).count() == 0


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5), ("c d", 3, -2.0)], "name string, age int, x double")
    S.write_tsv(df, str(tmp_path / "t"))
    back = S.read_tsv(spark, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and rows(back) == rows(df)
    (tmp_path / "none").write_text("1\t2\n")
    with pytest.raises(ValueError):
        S.read_tsv(spark, str(tmp_path / "none"))
    assert not S.is_sample_header(spark, str(tmp_path / "t"))


def test_samples(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    for i, (cell, n) in enumerate([("k562", "1"), ("hepg2", "2.5")]):
        (d / f"s{i}").write_text(f"chr1\t{i}\t9\tn\t3\t+\nchr2\t1\t2\tm\t0\t-\n")
        (d / f"s{i}.meta").write_text(f"cell\t{cell}\nn\t{n}\n")
    ds = S.read_samples(spark, str(d))
    assert rows(ds.samples) == [("s0", "k562", 1.0), ("s1", "hepg2", 2.5)] and ds.regions.count() == 4
    assert S.read_samples(spark, str(d), ["s1"]).regions.select("sid").distinct().count() == 1
    S.write_samples(ds, str(tmp_path / "w"))
    back = S.load_samples(spark, str(tmp_path / "w"))
    assert rows(back.regions.select(ds.regions.columns)) == rows(ds.regions) and rows(back.samples) == rows(ds.samples)
    (tmp_path / "list").write_bytes(b"a\rb\rc")
    assert S.read_id_list(spark, str(tmp_path / "list")) == ["a", "b", "c"]


def test_fasta(spark, tmp_path):
    (tmp_path / "f").write_text("; comment\n>P1 one\tx\ty\nACDE\nFGH\n>P2\nAAAA\n")
    got = S.read_fasta(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in got.where("name <> ''").collect()] == [("P1 one", ["x", "y"], "ACDEFGH"), ("P2", [], "AAAA")]
    S.write_fasta(spark.createDataFrame([("q", "A" * 165)], "name string, seq string"), str(tmp_path / "o"))
    assert rows(S.read_fasta(spark, str(tmp_path / "o")).select("name", "seq")) == [("q", "A" * 165)]


def test_run_and_inference(spark, tmp_path):
    psm = lambda seq, score, acc: "\t".join(["PEPTIDE", "1.0", "2.0", str(score), "1", seq, "2", "K", "R", "t", "id", acc, ";".join("1" for _ in acc.split(";")), ";".join("9" for _ in acc.split(";")), "1", "2"])
    text = ["RUN\tr1\tPEP\tfalse\tnow\t1\tp", psm("A(Oxidation)B", 0.1, "P1;P2"), psm("AB", 0.05, "P1;P2"), psm("CC", 0.2, "DECOYP3"), psm("DD", 1.0, "P1"), "PROTEIN\t1.0\t1\tP1\td\t0.5\tSEQ\ttarget"]
    (tmp_path / "run").write_text("\n".join(text) + "\n")
    run, peptides, proteins = S.read_run(spark, str(tmp_path / "run"))
    assert run.first().run_id == "r1" and proteins.first().accession == "P1" and peptides.count() == 4
    assert peptides.where("sequence like 'A(%'").first().hits[1].accession == "P2"
    sizes = spark.createDataFrame([("P1", 10), ("P2", 30), ("DECOYP3", 5)], "pro string, len int")
    got = {r.pro: r for r in X.without_complexes(peptides, sizes).collect()}
    assert abs(got["P1"].accPEP - (1 - 0.95 * 0.75)) < 1e-12 and got["DECOYP3"].label == -1 and abs(got["DECOYP3"].accPEP - 0.2) < 1e-12
    cpx = spark.createDataFrame([(1, "P1"), (1, "P2"), (2, "P9")], "cpxId int, pro string")
    marked = {(r.cpxId, r.pro): r for r in X.annotated(cpx, X.without_complexes(peptides, sizes)).collect()}
    mean = (got["P1"].accPEP + got["P2"].accPEP) / 2
    assert abs(marked[1, "P1"].targetProb - mean) < 1e-12 and marked[2, "P9"].targetProb == 1.0 and marked[1, "P2"].decoyProb == 1.0
    better = {r.pro: r.accPEP for r in X.with_complexes(peptides, sizes, cpx).collect()}
    assert abs(better["P2"] - mean) < 1e-12 and abs(better["P1"] - got["P1"].accPEP) < 1e-12
    final = X.iterated(peptides, sizes, cpx)
    assert final.count() == 3 and X.analysis(final, X.without_complexes(peptides, sizes), 1.0)["cpx_only"].count() == 0


def test_corum_reads_all_fields_by_their_place(spark, tmp_path):
    f = ["1", "C", "Human", "syn", "line", "P1;P2;P3", "1;2", "method", "GO:1;GO:2", "a", "F1", "x;y", "g1", "about", "99", "note", "ill", "Homo", "z1;z2", "n1;n2;n3"]
    (tmp_path / "c").write_text("ComplexID\tx\n" + "\t".join(f) + "\n")
    r = S.read_corum(spark, str(tmp_path / "c")).first()
    plain = (r.complexID, r.complexName, r.organism, r.synonyms, r.cellLine, r.purification, r.subunitsComment, r.pubMedID, r.complexComment, r.diseaseComment, r.swissprotOrganism)
    assert plain == (1, "C", "Human", "syn", "line", "method", "about", 99, "note", "ill", "Homo")
    assert [tuple(x) for x in r.go] == [("GO:1", "a")] and [tuple(x) for x in r.funcat] == [("F1", "x")]
    assert [tuple(u) for u in r.subunits] == [("P1", "1", "g1", "n1", "z1"), ("P2", "2", "", "n2", "z2"), ("P3", "", "", "n3", "")]
    assert X.complexes(S.read_corum(spark, str(tmp_path / "c"))).count() == 3


def test_sample_kinds_are_told_apart(spark, tmp_path):
    ds = Dataset(spark.createDataFrame([("a", 1, None), ("b", None, "x")], "sid string, n int, cell string"), spark.createDataFrame([("a", "c", 1, 2, "n", 3, "+")], "sid string, chrom string, start int, end int, name string, score int, strand string"))
    S.write_sample_text(ds, str(tmp_path / "text"))
    S.write_sample_folder(ds, str(tmp_path / "folder"))
    for back in (S.open_samples(spark, str(tmp_path / "text")), S.open_samples(spark, str(tmp_path / "folder-list"), str(tmp_path / "folder"))):
        assert rows(back.samples.select("sid", "n", "cell")) == [("a", 1, None), ("b", None, "x")] and rows(back.regions) == rows(ds.regions)


def test_stream(spark, tmp_path):
    marks = spark.createDataFrame([("c", 0, 10, "+"), ("c", 20, 30, "-")], "chrom string, start int, end int, strand string")
    arriving = [("c", 5, 6, "n", 2, "+"), ("c", 9, 21, "n", 3, "."), ("c", 40, 50, "n", 9, "+")]
    rows_in = spark.createDataFrame(arriving, "chrom string, start int, end int, name string, score int, strand string")
    rows_in.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows_in.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    map_stream(marks, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = totals(marks, spark.read.parquet(str(tmp_path / "out")))
    assert rows(got) == rows(R.map_r(marks, rows_in, total=A.total("score")).select(got.columns))
