"""Bindings of the given tables to the library's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt over the cluster if it comes in fewer partitions than there are cores, as a small table in one file does; other tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df` of short rows, from which much is made, dealt over the cluster by its key. A file of one row group is read by one task, into however many partitions Spark splits it."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def longs(df: DataFrame) -> DataFrame:
    """`df` with all int columns as bigint, the type that the SQL side gives."""
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: corpus is the source, doc_version the language."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars"))
    url = F.concat_ws("/", F.lit("https://docs.example"), "source", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("corpus"), F.col("lang").alias("doc_version"), F.concat_ws(" > ", "source", "lang").alias("heading_path"), url.alias("source_url"), F.col("text").alias("content"), "n_chars")


CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, source AS corpus, lang AS doc_version, source || ' > ' || lang AS heading_path, 'https://docs.example/' || source || '/' || doc_id AS source_url, text AS content, n_chars FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set with two words of the document of the same id as its text. Only documents of a query are taken apart, where they met it."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return asked_vectors(spark, sf_dir).join(docs, "query_id", "left").withColumn("query", F.coalesce(_two_words(), F.lit(""))).drop("text")


def _two_words():
    long_words = F.sort_array(F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 4)))
    return F.array_join(F.slice(long_words, 1, 2), " ")


WORDS_SQL = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
QUESTIONS_SQL = (
    "questions AS (SELECT e.vec_id AS query_id, e.embedding, e.label, coalesce(array_to_string(list_slice(list_filter(list_sort(list_distinct(regexp_extract_all(lower(d.text), '" + WORDS_SQL + "'))), "
    "lambda w: length(w) >= 4), 1, 2), ' '), '') AS query FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0)"
)
