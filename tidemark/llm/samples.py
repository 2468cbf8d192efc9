"""Bounded training samples and fold arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: More labels than this are an error: no classifier is meant to have them, and its sample grows with them.
MOST_LABELS = 2_000


def fold(id_: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null without an id."""
    return F.crc32(F.col(id_).cast("string").cast("binary")) % folds


def row_key(text: str = "text", id_: str = "doc_id") -> Column:
    """A hash of id and text, in whose order rows are drawn; repeated rows have one key."""
    return F.xxhash64(F.col(id_), F.col(text), F.lit(7))


def labelled_sample(keyed: DataFrame, docs: DataFrame, label: str, per_label: int, bytes_per_label: int) -> list[tuple[str, object]]:
    """(text, label) of at most `per_label` different rows of each label, and of no more than `bytes_per_label` bytes or one text.

    `keyed` has (label, key, n): the row_key and the bytes of every row that may be drawn; `docs` has the texts. Every label with a row is
    in the sample, and texts are whole. The same rows are drawn at every run. Repeated rows count once. A threshold on the key, from each label's
    approximate number of different rows, leaves about twice the rows that may be drawn, so that no label's rows are brought together; only what was drawn is collected.
    """
    counts = cut(keyed.groupBy(label).agg(F.approx_count_distinct("key").alias("rows")))
    if counts.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    few = F.pmod("key", F.lit(1 << 30)) < F.lit(float(1 << 30)) * (2 * per_label + 100) / F.col("rows")
    by = Window.partitionBy(label).orderBy("key")
    once = keyed.join(F.broadcast(counts), label).filter(few).groupBy(label, "key").agg(F.max("n").alias("n"))
    ranked = once.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= per_label)
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = cut(ranked.withColumn("before", before).filter((F.col("place") == 1) | (F.col("before") + F.col("n") <= bytes_per_label)).select(label, "key"))
    texts = docs.select(row_key().alias("key"), "text").join(F.broadcast(drawn), "key")
    rows = texts.groupBy(label, "key").agg(F.first("text").alias("text")).orderBy(label, "key").collect()
    return [(r["text"], r[label]) for r in rows]
