"""Protein inference: from peptide matches to proteins with false discovery rates, refined by complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import confidence, label
from ..operators.joins import running
from ..session import cut_lineage

THRESHOLD, QVAL, FEWEST = 0.999, 0.01, 10


def selected(peptides: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pep, pro, score: the least score of each peptide and protein among matches up to the threshold. peptides: pep, score, hits (array with accession)."""
    rows = peptides.where(F.col("score") <= threshold).select("pep", "score", F.explode("hits.accession").alias("pro"))
    return rows.groupBy("pep", "pro").agg(F.min("score").alias("score"))


def normalized(hits: DataFrame, proteins: DataFrame) -> DataFrame:
    """hits and falseProb: a peptide's probability is dealt to its proteins by the inverse of their lengths. proteins: pro, len."""
    weight = 1.0 / F.col("len")
    own = hits.join(proteins.select("pro", "len"), "pro").withColumn("_w", weight)
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy("pep"))
    return own.select("pep", "pro", "score", (1.0 - (1.0 - F.col("score")) * share).alias("falseProb"))


def scored(hits: DataFrame) -> DataFrame:
    """pro, accPEP, conf, label."""
    return hits.groupBy("pro").agg(F.product("falseProb").alias("accPEP")).select("pro", "accPEP", confidence(F.col("accPEP")).alias("conf"), label(F.col("pro")).alias("label"))


#: Confidences are cumulated in stretches of this width; they lie between 0 and 140.
STRETCH = 0.05


def with_fdr(calls: DataFrame) -> DataFrame:
    """calls and fdr, qval. Cumulated over distinct confidences, in stretches, so no task holds all of them.

    Calls are written first: their sums depend on the order in which rows come, and a confidence that is found twice
    may differ in its last digit, so it would meet none.
    """
    calls = cut_lineage(calls)
    per = calls.groupBy("conf").agg(F.sum((F.col("label") == -1).cast("long")).alias("d"), F.sum((F.col("label") == 1).cast("long")).alias("t"))
    per = running(per.withColumn("_down", -F.col("conf")), [], "_down", [], {"decoys": F.col("d"), "targets": F.col("t")}, STRETCH)
    per = per.select("conf", ((1.0 + F.col("decoys")) / (1.0 + F.col("targets"))).alias("fdr"))
    per = running(per, [], "conf", [], {"_most": -F.col("fdr")}, STRETCH, best=True).select("conf", "fdr", F.least(F.lit(1.0), -F.col("_most")).alias("qval"))
    return calls.join(per, "conf").select("pro", "accPEP", "conf", "label", "fdr", "qval")


def complexes(corum: DataFrame, organism: str = "Human") -> DataFrame:
    """cpxId, pro of the organism's complexes. corum: complexID, organism, subunits (array with uniprotID)."""
    return corum.where(F.col("organism") == organism).select(F.col("complexID").alias("cpxId"), F.explode("subunits.uniprotID").alias("pro")).distinct()


def annotated(cpx: DataFrame, calls: DataFrame) -> DataFrame:
    """cpx with targetProb, decoyProb: the mean over members of their least accPEP where below 1, else 1. calls: pro named as in cpx."""
    least = lambda k, n: calls.where(F.col("label") == k).groupBy("pro").agg(F.min("accPEP").alias(n))
    own = cpx.join(least(1, "_t"), "pro", "left").join(least(-1, "_d"), "pro", "left")
    w = Window.partitionBy("cpxId")
    mean = lambda n: F.coalesce(F.avg(F.when(F.col(n) < 1.0, F.col(n))).over(w), F.lit(1.0))
    return own.select("cpxId", "pro", mean("_t").alias("targetProb"), mean("_d").alias("decoyProb"))


def refined(calls: DataFrame, cpx: DataFrame, name=None) -> DataFrame:
    """calls again, each protein as sure as the surest of its complexes if that is surer. name: of a protein in cpx, from its call's (default: itself)."""
    own = calls.withColumn("_name", name(F.col("pro")) if name else F.col("pro"))
    marked = annotated(cpx, own.select(F.col("_name").alias("pro"), "accPEP", "label"))
    best = marked.groupBy("pro").agg(F.min("targetProb").alias("_t"), F.min("decoyProb").alias("_d")).withColumnRenamed("pro", "_name")
    p = F.coalesce(F.when(F.col("label") == 1, F.col("_t")).otherwise(F.col("_d")), F.col("accPEP"))
    rows = own.join(best, "_name", "left").withColumn("_p", p)
    better = F.col("accPEP") >= F.col("_p")
    rows = rows.select("pro", F.when(better, F.col("_p")).otherwise(F.col("accPEP")).alias("accPEP"), F.when(better, confidence(F.col("_p"))).otherwise(F.col("conf")).alias("conf"), "label")
    return with_fdr(rows)


def without_complexes(peptides: DataFrame, proteins: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return with_fdr(scored(normalized(selected(peptides, threshold), proteins)))


def with_complexes(peptides: DataFrame, proteins: DataFrame, cpx: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return refined(without_complexes(peptides, proteins, threshold), cpx)


def iterated(peptides: DataFrame, proteins: DataFrame, cpx: DataFrame, threshold: float = THRESHOLD, qval: float = QVAL, name=None, rounds: int = 50, fewest: int = FEWEST) -> DataFrame:
    """Refined until fewer than ``fewest`` more targets are called, or ``rounds`` times."""
    called = lambda df: df.where((F.col("label") == 1) & (F.col("qval") < qval)).count()
    before = cut_lineage(without_complexes(peptides, proteins, threshold))
    n = called(before)
    for _ in range(rounds):
        before = cut_lineage(refined(before, cpx, name))
        m = called(before)
        if m - n < fewest:
            break
        n = m
    return before


def analysis(cpx: DataFrame, nocpx: DataFrame, qval: float = QVAL) -> dict[str, DataFrame]:
    """Called targets of two results, and those that only one has."""
    kept = lambda df: df.where((F.col("label") == 1) & (F.col("qval") < qval))
    a, b = kept(cpx), kept(nocpx)
    return {"cpx": a, "nocpx": b, "cpx_only": a.join(b, "pro", "left_anti"), "nocpx_only": b.join(a, "pro", "left_anti")}
