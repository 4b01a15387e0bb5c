"""Text sources and sinks: lines, typed TSV, FASTA, interval tables, sample lists, peptide matches, complexes.

Readers keep to Columns over lines, so scans stay split and projections are pruned. Files with a header tell
their schema in the first line, which alone is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import bare_sequence, sniffed, zipped
from ..operators.ordered import OrderedFrame
from ..operators.samples import Dataset

TYPES = {"Int": "int", "Double": "double", "String": "string", "Boolean": "boolean"}
NAMES = {"int": "Int", "bigint": "Int", "double": "Double", "string": "String", "boolean": "Boolean"}
BED = [("chrom", "string"), ("start", "int"), ("end", "int"), ("name", "string"), ("score", "int"), ("strand", "string")]
NARROW_PEAK = [("signalval", "double"), ("pval", "double"), ("qval", "double"), ("peak", "int")]
#: First word of the line that tells an interval table's further columns.
BED_HEADER = "#columns"
SKIPPED = ("track", "browser", "#")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line: each line, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def parsed(spark: SparkSession, path: str, guard: Column | None, columns: list[tuple[str, str]], sep: str = "\t") -> DataFrame:
    """Named, typed columns of the lines that guard lets through; a field that isn't of its type, or isn't there, is null."""
    rows = lines(spark, path).where(guard if guard is not None else F.col("line") != "")
    parts = F.split("line", sep)
    return rows.select(*(F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)))


def write_lines(df: DataFrame, path: str, *cols: Column | str, sep: str = "\t", header: str | None = None) -> None:
    """A line a row, a file a partition. A header is a file of its own beside them; readers find it wherever it is."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols or df.columns]
    out = df.select(F.concat_ws(sep, *text).alias("value"))
    if header is None:
        out.write.mode("overwrite").text(path)
    else:
        spark = df.sparkSession
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        out.write.mode("append").text(path)


def write_file(df: DataFrame, path: str) -> None:
    """One text file of df's one column. It is written by one task, as one file must be."""
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    fs, of = _files(spark, path)
    part = next(x.getPath() for x in fs.listStatus(of(f"{path}.parts")) if x.getPath().getName().startswith("part-"))
    fs.delete(of(path), True)
    fs.rename(part, of(path))
    fs.delete(of(f"{path}.parts"), True)


def _files(spark: SparkSession, path: str):
    """The file system that path is in, and what makes paths of it."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def size_on_disk(spark: SparkSession, path: str) -> int:
    fs, of = _files(spark, path)
    return fs.getContentSummary(of(path)).getLength()


def saved_as(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read from there. Types stay."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def renamed(spark: SparkSession, path: str, to: str) -> DataFrame:
    """What saved_as wrote to path, moved."""
    fs, of = _files(spark, path)
    fs.rename(of(path), of(to))
    return spark.read.parquet(to)


def ordered_file(spark: SparkSession, path: str, keys: tuple[str, ...], columns: list[tuple[str, str]], guard: Column | None = None) -> OrderedFrame:
    """A file's lines as a collection in order of keys; without keys, as they are. A missing file raises when it is opened."""
    return OrderedFrame(parsed(spark, path, guard, columns), keys)


# Typed TSV: the first line is name:Type for each column.


def header_schema(line: str) -> list[tuple[str, str]]:
    return [(f.rpartition(":")[0] or f, TYPES.get(f.rpartition(":")[2], "string")) for f in line.rstrip("\r\n").split("\t")]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    first = [r.value for r in spark.read.text(path).where(F.col("value").rlike(r"^[^\t]+:(Int|Double|String|Boolean)(\t|$)")).limit(1).collect()]
    if not first:
        raise ValueError(f"{path} has no header")
    return parsed(spark, path, (F.col("line") != F.trim(F.lit(first[0]))) & (F.col("line") != ""), header_schema(first[0]))


def write_tsv(df: DataFrame, path: str) -> None:
    write_lines(df, path, header="\t".join(f"{n}:{NAMES.get(t, 'String')}" for n, t in df.dtypes))


# Interval tables.


def read_bed(spark: SparkSession, path: str, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Six fixed columns, then extra, or those that a header line of the file tells. Comments, track and browser lines are skipped; lines without six fields or a whole score too."""
    if extra is None:
        first = spark.read.text(path).where(F.col("value").startswith(BED_HEADER)).limit(1).collect()
        extra = header_schema(first[0].value.split("\t", 1)[1]) if first and "\t" in first[0].value else []
    guard = F.lit(True)
    for s in SKIPPED:
        guard = guard & ~F.col("line").startswith(s)
    return parsed(spark, path, guard, BED + extra).where("`start` is not null and `end` is not null and score is not null and strand is not null")


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path, NARROW_PEAK)


def write_bed(df: DataFrame, path: str) -> None:
    """With a header that tells the further columns, in order of name."""
    fixed = [n for n, _ in BED]
    more = sorted(c for c in df.columns if c not in fixed)
    kinds = dict(df.dtypes)
    write_lines(df, path, *fixed, *more, header="\t".join([BED_HEADER, *(f"{c}:{NAMES.get(kinds[c], 'String')}" for c in more)]))


def empty_bed(spark: SparkSession, extra: list[tuple[str, str]] = ()) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in [*BED, *extra]))


# Samples: a list of ids, and for each id a file of intervals and one of metadata beside it.


def _metadata(meta: DataFrame) -> DataFrame:
    """A row a sample of sid, k, v. Values are typed by the narrowest type that fits all of a key's."""
    kinds = {r.k: r.kinds for r in meta.groupBy("k").agg(F.collect_set(sniffed(F.col("v"))).alias("kinds")).collect()}  # a row a key of metadata
    wide = meta.groupBy("sid").pivot("k", sorted(kinds)).agg(F.first("v"))
    kind = lambda ks: "string" if "String" in ks else "double" if "Double" in ks else "int"
    return wide.select("sid", *(F.col(f"`{k}`").cast(kind(kinds[k])).alias(k) for k in sorted(kinds) if k != "sid"))


def _tracks(rows: DataFrame, extra: list[tuple[str, str]] | None) -> DataFrame:
    """Intervals of rows' sid and value (a line)."""
    parts = F.split(F.trim("value"), "\t")
    cols = BED + (extra or [])
    rows = rows.where(F.size(parts) >= 6).where(~F.col("value").startswith("#") & ~F.col("value").startswith("track") & ~F.col("value").startswith("browser"))
    return rows.select("sid", *(F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(cols))).where("`start` is not null and score is not null")


def read_samples(spark: SparkSession, folder: str, ids: list[str] | None = None, extra: list[tuple[str, str]] | None = None) -> Dataset:
    """folder/<id> and folder/<id>.meta (key TAB value lines). ids None: all that have a .meta. Values are typed by the narrowest type that fits all of a key's."""
    base = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    meta = spark.read.text(f"{folder}/*.meta").select(F.regexp_replace(base, r"\.meta$", "").alias("sid"), F.split(F.trim("value"), "\t", 2).alias("p")).where(F.size("p") == 2)
    meta = meta.select("sid", F.col("p")[0].alias("k"), F.col("p")[1].alias("v"))
    if ids is not None:
        meta = meta.where(F.col("sid").isin(ids))
    wide = _metadata(meta)
    rows = spark.read.option("pathGlobFilter", "*").text(folder).withColumn("sid", base).where(~F.col("sid").endswith(".meta"))
    return Dataset(wide, _tracks(rows, extra).join(wide.select("sid"), "sid", "left_semi"))


def _track_lines(regions: DataFrame) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*(n for n, _ in BED), *sorted(c for c in regions.columns if c not in ("sid", *(n for n, _ in BED)))]))


def _meta_lines(samples: DataFrame) -> Column:
    """key TAB value lines, of the values that a sample has."""
    pairs = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "\t"), F.col(c).cast("string"))) for c in samples.columns if c != "sid"))
    return F.array_join(pairs, "\n")


def write_sample_folder(ds: Dataset, folder: str) -> None:
    """As read_samples reads it: two files a sample, each by one task, and list.txt of the ids. Further columns of regions are in order of name."""
    spark = ds.samples.sparkSession
    ids = [r.sid for r in ds.samples.select("sid").collect()]  # a row a sample
    for sid in ids:
        write_file(ds.regions.where(F.col("sid") == sid).select(_track_lines(ds.regions)), f"{folder}/{sid}")
        write_file(ds.samples.where(F.col("sid") == sid).select(_meta_lines(ds.samples)), f"{folder}/{sid}.meta")
    write_file(spark.createDataFrame([(i,) for i in ids], "value string"), f"{folder}-list")


# Samples in one text file: a header, then for each the path of its track, key TAB value lines and an empty line.

#: Begins the header line; what follows in it isn't read.
SAMPLE_HEADER = "##"


def read_sample_text(spark: SparkSession, path: str, extra: list[tuple[str, str]] | None = None) -> Dataset:
    """Tracks are files or folders; sid is the last part of a track's path, without sid=."""
    entries = spark.read.option("lineSep", "\n\n").text(path).select(F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(SAMPLE_HEADER)).alias("l")).where(F.size("l") > 0)
    name = lambda c: F.regexp_extract(c, r"(?:^|/)(?:sid=)?([^/]+)/*$", 1)
    own = entries.select(name(F.col("l")[0]).alias("sid"), F.col("l")[0].alias("track"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("l"))
    meta = own.select("sid", F.explode("l").alias("x")).select("sid", F.split("x", "\t", 2).alias("p")).where(F.size("p") == 2)
    tracks = [r.track for r in own.select("track").distinct().collect()]  # a path a sample
    wide = own.select("sid").join(_metadata(meta.select("sid", F.col("p")[0].alias("k"), F.col("p")[1].alias("v"))), "sid", "left")
    rows = spark.read.text(tracks).withColumn("sid", name(F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", ""))) if tracks else spark.createDataFrame([], "value string, sid string")
    return Dataset(wide, _tracks(rows, extra))


def write_sample_text(ds: Dataset, path: str) -> None:
    """Tracks first, in folders beside path, then the entries that name them. Ids are fit for names of files; a sample without regions has an empty folder."""
    spark, folder = ds.samples.sparkSession, f"{path}-tracks"
    ds.regions.select("sid", _track_lines(ds.regions).alias("value")).write.mode("overwrite").partitionBy("sid").text(folder)
    fs, of = _files(spark, folder)
    for r in ds.samples.select("sid").collect():  # a row a sample
        fs.mkdirs(of(f"{folder}/sid={r.sid}"))
    spark.createDataFrame([(f"{SAMPLE_HEADER} samples",)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    ds.samples.select(F.concat(F.lit(f"{folder}/sid="), "sid", F.lit("\n"), _meta_lines(ds.samples))).write.mode("append").option("lineSep", "\n\n").text(path)


def open_samples(spark: SparkSession, path: str, folder: str | None = None, extra: list[tuple[str, str]] | None = None) -> Dataset:
    """Either kind, told by the header: samples in one text file, or a list of ids of samples in folder."""
    if is_sample_header(spark, path):
        return read_sample_text(spark, path, extra)
    return read_samples(spark, folder or path.rpartition("/")[0], read_id_list(spark, path), extra)


def read_id_list(spark: SparkSession, path: str) -> list[str]:
    """Ids of a list file, split at any kind of line end."""
    return [w for r in spark.read.text(path, wholetext=True).collect() for w in r.value.replace("\r", "\n").split("\n") if w.strip()]


def write_samples(ds: Dataset, folder: str) -> None:
    """Metadata and regions as Parquet, regions by sid."""
    ds.samples.write.mode("overwrite").parquet(f"{folder}/samples")
    ds.regions.write.mode("overwrite").partitionBy("sid").parquet(f"{folder}/regions")


def load_samples(spark: SparkSession, folder: str) -> Dataset:
    samples = spark.read.parquet(f"{folder}/samples")
    rows = spark.read.parquet(f"{folder}/regions").withColumn("sid", F.col("sid").cast("string"))
    return Dataset(samples, rows)


def is_sample_header(spark: SparkSession, path: str) -> bool:
    """Whether a file has the header of samples in one text file, rather than ids."""
    return not spark.read.text(path).where(F.col("value").startswith(SAMPLE_HEADER)).isEmpty()


# FASTA.


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, misc (array of the header's further fields), seq of each entry. Lines that begin with ; are comments."""
    entries = spark.read.option("lineSep", "\n>").text(path)
    rows = F.filter(F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n"), lambda x: ~x.startswith(";") & (F.trim(x) != ""))
    own = entries.select(rows.alias("l")).where(F.size("l") > 0)
    head = F.split(F.regexp_replace(F.col("l")[0], r"^>", ""), "\t")
    return own.select(F.trim(head[0]).alias("name"), F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(0))).alias("misc"), F.regexp_replace(F.array_join(F.slice("l", 2, F.size("l")), ""), r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.concat_ws("\t", F.concat(F.lit(">"), "name"), "misc") if "misc" in df.columns else F.concat(F.lit(">"), "name")
    df.select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


# Peptide matches: one file holds a run line, matches and proteins.

# The columns of the three kinds of line, in the format's order.
PSM = [(n, "string") for n in ("kind", "rt", "mz", "score", "rank", "sequence", "charge", "aa_before", "aa_after", "score_type", "search_id", "accessions", "starts", "ends", "predicted_rt", "predicted_pt")]
PROTEIN = [("kind", "string"), ("score", "double"), ("rank", "int"), ("accession", "string"), ("description", "string"), ("coverage", "double"), ("sequence", "string"), ("target_decoy", "string")]
RUN = [(n, "string") for n in ("kind", "run_id", "score_type", "score_direction", "date_time", "engine_version", "parameters")]


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """A row a match, with pep (the sequence without marks) and hits: accession, start and end, as many as the shortest list has."""
    raw = parsed(spark, path, F.col("line").startswith("PEPTIDE"), PSM)
    z = F.transform(zipped(F.col("accessions"), F.col("starts"), F.col("ends")), lambda h: F.struct(h["0"].alias("accession"), h["1"].try_cast("int").alias("start"), h["2"].try_cast("int").alias("end")))
    doubles, ints = ("rt", "mz", "score"), ("rank", "charge", "predicted_rt", "predicted_pt")
    typed = [F.col(c).try_cast("double" if c in doubles else "int" if c in ints else "string").alias(c) for c, _ in PSM[1:] if c not in ("accessions", "starts", "ends")]
    return raw.select(*typed, bare_sequence(F.col("sequence")).alias("pep"), z.alias("hits"))


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, F.col("line").startswith("PROTEIN"), PROTEIN).drop("kind")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run, matches and proteins of one file."""
    return parsed(spark, path, F.col("line").startswith("RUN"), RUN).drop("kind"), read_peptides(spark, path), read_proteins(spark, path)


def write_run(run: DataFrame, peptides: DataFrame, proteins: DataFrame, path: str) -> None:
    """As read_run reads it. run has the columns of RUN but kind; the others are as their readers give them."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda kind, cols: F.concat_ws("\t", F.lit(kind), *map(text, cols)).alias("value")
    lists = {"accessions": "accession", "starts": "start", "ends": "end"}
    hits = lambda c: F.array_join(F.transform("hits", lambda h: text(h[lists[c]])), ";")
    out = run.select(line("RUN", [F.col(c) for c, _ in RUN[1:]])).union(proteins.select(line("PROTEIN", [F.col(c) for c, _ in PROTEIN[1:]])))
    out = out.union(peptides.select(line("PEPTIDE", [hits(c) if c in lists else F.col(c) for c, _ in PSM[1:]])))
    heads = [("#" + "\t".join([kind, *(c for c, _ in cols[1:])]),) for kind, cols in (("RUN", RUN), ("PROTEIN", PROTEIN), ("PEPTIDE", PSM))]
    run.sparkSession.createDataFrame(heads, "value string").union(out).write.mode("overwrite").text(path)


# Protein complexes: 20 columns, some of them lists.

# The columns in the format's order.
CORUM = [
    "complexID", "complexName", "organism", "synonyms", "cellLine", "subunitsUniProt", "subunitsEntrez", "purification", "goID", "goDescription",
    "funCatID", "funCatDescription", "subunitsGeneName", "subunitsComment", "pubMedID", "complexComment", "diseaseComment", "swissprotOrganism", "subunitsGeneSynonyms", "subunitsProteinName",
]


def _padded(*cols: str) -> Column:
    """Lists side by side, as long as the longest, with empty strings behind the shorter."""
    lists = [F.split(F.coalesce(F.col(c), F.lit("")), ";") for c in cols]
    longest = F.greatest(*(F.size(x) for x in lists))
    even = [F.concat(x, F.array_repeat(F.lit(""), longest - F.size(x))) for x in lists]
    return F.arrays_zip(*even)


def read_corum(spark: SparkSession, path: str) -> DataFrame:
    """complexID, complexName, organism and further columns, with go and funcat (as long as the shorter list) and subunits (as long as the longest)."""
    raw = parsed(spark, path, F.col("line").rlike(r"^\d"), [(c, "string") for c in CORUM])
    pair = lambda a, b: F.transform(zipped(F.col(a), F.col(b)), lambda h: F.struct(h["0"].alias("id"), h["1"].alias("description")))
    names = ("uniprotID", "entrezID", "geneName", "proteinName", "geneSynonyms")
    z = _padded("subunitsUniProt", "subunitsEntrez", "subunitsGeneName", "subunitsProteinName", "subunitsGeneSynonyms")
    subunits = F.transform(z, lambda h: F.struct(*(h[str(i)].alias(n) for i, n in enumerate(names))))
    plain = ("complexName", "organism", "synonyms", "cellLine", "purification", "complexComment", "diseaseComment", "subunitsComment", "swissprotOrganism")
    return raw.select(F.col("complexID").try_cast("int").alias("complexID"), F.col("pubMedID").try_cast("int").alias("pubMedID"), *plain, pair("goID", "goDescription").alias("go"), pair("funCatID", "funCatDescription").alias("funcat"), subunits.alias("subunits"))
