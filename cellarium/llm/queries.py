"""The registered queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, containment, packing, pages, quality, search, simhash, suffix, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", quality.held_out("row.doc_id").alias("held_out"), "score", "predicted")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.suffix_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunks.chunk_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_bytes", "n_chunks", "n_lost", "n_removed", "n_spans", "kept_sha256")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_records(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(docs, docs.filter(F.col("doc_id") % 20 == 0))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality, op2_suffix, op3_chunks, op4_records, op5_decontaminate,
        op6_search, op7_extract, op8_simhash, op9_pack, op10_chat,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
