"""The corpus pipeline: classify, drop near-duplicates, cut repeats, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import common, containment, packing, quality, simhash, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.quality(docs, _table(spark, sf_dir, "labels")).filter("predicted = 1").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id, then the least hash of its text.

    Rows without doc_id name no group and stay; of rows with the least doc_id and equal texts one stays.
    """
    tie = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", tie.alias("tie"))  # without doc_id last
    first = (
        simhash.near_duplicates(docs.select(row.alias("doc_id"), "text"))
        .filter("doc_id = component_id and not doc_id.missing")
        .select(F.col("doc_id.doc_id").alias("kept_id"), F.col("doc_id.tie").alias("kept_tie")).distinct()
    )
    kept = (
        docs.withColumn("own_tie", tie).join(first, F.expr("doc_id = kept_id and own_tie = kept_tie"), "left_semi")
        .dropDuplicates(["doc_id", "own_tie"]).drop("own_tie")
    )
    return kept.unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that repeat; what a cut leaves of a character goes too. Null stays null."""
    decoded = F.pandas_udf(lambda raw: raw.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    cut = suffix.suffix_dedup(docs)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(decoded(F.col("kept")))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return cut.select(row.alias("row")).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.contained(docs, _table(spark, sf_dir, "benchmark")).filter("size(hits) = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in the batches of its length bucket."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage but the last could be said in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), "stage")
    return docs
