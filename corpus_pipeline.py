"""A training corpus from raw documents, as stages that each read what the one before wrote.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal
data, BPE encoding. All stages but the last return the columns of their input.
Rows with null texts, repeated rows and extra columns are handled as each
operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.llm import bpe, lsh_forest, pii, quality_model, winnowing
from lodecast.llm.files import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, at its cutoff for filters."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return lsh_forest.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return winnowing.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and ``n_chars`` counted again."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    read = bpe.decode(bpe.encode(docs, path), bpe.id_to_piece(spark, path))
    return read.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE encoding", encoding),
]

#: The quality model is fitted, so the rows cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
