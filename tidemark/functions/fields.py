"""Scalar functions of the applications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modification marks in peptide sequences, in the order in which they are removed.
MODIFICATIONS = [r"\(Oxidation\)", r"\(Carbamidomethyl\)", r"\.\(Glu->pyro-Glu\)", r"\.\(Gln->pyro-Glu\)", r"\.\(Acetyl\)", r"\.\(Ammonia-loss\)"]


def bare_sequence(sequence: Column) -> Column:
    for m in MODIFICATIONS:
        sequence = F.regexp_replace(sequence, m, "")
    return sequence


def uniprot(name: Column) -> Column:
    parts = F.split(name, r"\|")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(name)


def protein_name(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def label(name: Column) -> Column:
    return F.when(name.startswith("DECOY"), -1).otherwise(1)


def confidence(p: Column) -> Column:
    return -10 * F.log10(p + 1e-14)


def zipped(first: Column, *rest: Column, sep: str = ";") -> Column:
    """Arrays of equal places from joined lists, as long as the shortest."""
    lists = [F.split(x, sep) for x in (first, *rest)]
    n = F.least(*(F.size(x) for x in lists)) if rest else F.size(lists[0])
    return F.slice(F.arrays_zip(*lists), 1, n)


def sniffed(text: Column) -> Column:
    """The narrowest of Int, Double, String that a text is."""
    return F.when(text.try_cast("int").isNotNull() & text.rlike(r"^[+-]?\d+$"), "Int").when(text.try_cast("double").isNotNull(), "Double").otherwise("String")
