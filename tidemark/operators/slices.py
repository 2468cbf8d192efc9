"""Version slices: idempotent replacement, inventory, migration plan and composition."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import commit


def replace_slices(rows: DataFrame, path: str, keys: tuple[str, ...] = ("corpus", "doc_version")) -> None:
    """Rewrites exactly the slices that `rows` holds and leaves others alone; an empty frame fails before anything is touched."""
    if rows.isEmpty():
        raise ValueError("nothing to write: the stored slices stay as they are")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def merge_documents(rows: DataFrame, path: str, keys: tuple[str, ...] = ("corpus", "doc_version"), document: str = "doc_key") -> None:
    """Rewrites the slices that `rows` holds with their stored documents, of which those in `rows` are replaced. No row changes nothing.

    Stored files are read before the new ones are put in their place, when the write commits.
    """
    if rows.isEmpty():
        return
    spark, by = rows.sparkSession, [*keys, document]
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        replace_slices(rows, path, keys)
        return
    slices = rows.select(*keys).distinct()
    kept = stored.join(slices, list(keys), "left_semi").join(rows.select(*by).distinct(), by, "left_anti")
    replace_slices(rows.unionByName(kept), path, keys)


def replace_patch(tables: dict[str, DataFrame], folder: str) -> int:
    """Replaces the patches of several tables in one commit of the snapshots in `folder`; missing maps and arrays become empty. Readers see all of it or nothing."""
    filled = {}
    for name, rows in tables.items():
        empty = {c: F.coalesce(F.col(c), F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)) for c, kind in rows.dtypes if kind.startswith(("map", "array"))}
        filled[name] = rows.withColumns(empty)
    return commit(filled, folder, ("patch",))


def inventory(chunks: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(corpus, versions array<struct<doc_version, chunks>>, total) without the excluded corpora."""
    kept = chunks.filter(~F.col("corpus").isin(*excluded)) if excluded else chunks
    counts = kept.groupBy("corpus", "doc_version").agg(F.count("*").alias("chunks"))
    return counts.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("doc_version", "chunks"))).alias("versions"), F.sum("chunks").alias("total"))


def width_plan(chunks: DataFrame, dim: int) -> DataFrame:
    """Slices whose vectors don't have `dim` values: rows, least and greatest width."""
    widths = chunks.groupBy("corpus", "doc_version").agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    return widths.filter((F.col("least") != dim) | (F.col("most") != dim))


def composition(chunks: DataFrame, family: str) -> DataFrame:
    """Chunks, chunks with code, and the share of one source family in each slice."""
    share = F.count_if(F.contains("source_url", F.lit(family))) / F.count("*")
    return chunks.groupBy("corpus", "doc_version").agg(F.count("*").alias("chunks"), F.count_if(F.contains("content", F.lit("```"))).alias("with_code"), share.alias("family_share"))
