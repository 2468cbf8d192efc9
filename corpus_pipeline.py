"""Corpus pipeline: five stages that turn raw documents into a training corpus.

Language ID drops documents whose language is not accepted, near-dedup keeps one document of each class,
decontamination drops documents with benchmark passages, the secret scan puts a mark in place of
every secret, and the last stage encodes what is left. Each stage reads what the one before wrote.

Stages carry the columns of `documents` and no others: further columns of the input are dropped, whatever their names. Null texts and texts without a
letter go in the first stage; repeated rows are copies to the second. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, neardup, queries, secrets, sentencepieces
from tidemark.llm.shared import fresh_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express none of MinHash classes, the trained language model and the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, ~language.held_out())
    return language.keep_identified(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with begin and end as little-endian unsigned 32-bit integers, and their digests."""
    return sentencepieces.encode_pieces(docs, queries.piece_model()).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is written as Parquet in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
