"""The corpus pipeline: from documents to packed sequences in five stages.

Each stage reads what its predecessor kept, written as Parquet. All but the last return the columns of ``documents``, with ``n_chars`` of the text as it is then; the last
returns one row per piece of a document with its place in a sequence. SQL cannot express the chain (tokens, language profiles);
its operators are tested one by one, the chain against the operators called one after the other, on odd rows and on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import jaccard_join, language, line_rules, packing, suffix_dedup
from harrow.llm.catalog import table, vocabulary
from harrow.runtime import release, stabilise

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many texts of a source share go from the others."""
    return _measured(line_rules.keep_good(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are like no language go."""
    return language.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.without_near_copies(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has go."""
    return _measured(suffix_dedup.without_repeats(docs, size=50))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        kept = stabilise(stage(spark, docs, sf_dir))
        if number:  # what the stage has read is not read again
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
