"""A corpus, from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, language_id, mixing, packing, simhash_dedup, suffix_dedup

#: Bytes of a passage that may not repeat. 50 words are more than that.
PASSAGE = 240


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones have. Without letters, or as like any language as another: rejected. Null and empty texts have no letters. No rows: no rows."""
    return language_id.identified(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash: the smallest doc_id, null last. Null texts are as empty ones, which are alike."""
    return simhash_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also are elsewhere. One of which nothing is left goes; null and empty texts stay. Rows of equal text are copies of each other."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null sources are one source; null texts and texts without words are not taken."""
    return mixing.copies(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Null texts are as empty ones; null doc_ids stay null."""
    return packing.digest(docs)


STAGES = [("language_id", languages), ("simhash_dedup", near_copies), ("suffix_dedup", passages), ("mixing", mixture), ("packing", sequences)]
#: SQL can't express training, merging or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut_lineage(docs)
    return docs
