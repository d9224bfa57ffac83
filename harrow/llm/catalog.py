"""The registered queries of these operators; SQL stands beside those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import (
    conversations, html_text, jaccard_join, kneser_ney, language, license_scan, line_rules, packing, phrases, piece_codec, sharding,
    suffix_dedup, top_k,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op2_language_id")
def _language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op4_exact_top_k", top_k.SEARCH_SQL)
def _top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_k.grid_vectors(table(spark, folder, "embeddings"))
    return top_k.search(vectors, F.col("id") % 20 == 0, k=20)


@query("op6_piece_codec")
def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encoding_digest(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op9_quality_rules", line_rules.judge_sql())
def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(table(spark, folder, "documents")).drop("host", "text_hash", "shared_lines")


@query("op10_html_extraction")
def _html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query("op8_ngram_jaccard", jaccard_join.CLUSTER_SQL)
def _jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, folder, "documents")).drop("text_hash", "first")


@query("op7_suffix_dedup")
def _suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept", "digest")


@query("op3_license_scan", license_scan.scan_sql())
def _licences(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(license_scan.document_paths(table(spark, folder, "documents")))


@query("op5_kneser_ney_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_stratified_sharding", sharding.shard_sql())
def _shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op12_conversation_repair")
def _repairs(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.reports(conversations.damaged(table(spark, folder, "conversations")), present="present")


@query("op13_phrase_mining", phrases.collocation_sql())
def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
