"""Line files whose order counts: every line with the byte at which it begins, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of all lines of a file, or of the files of a folder one behind the other by name. `at` is the byte where a line begins in all of them; lines are bytes between line feeds, so carriage returns stay.

    A task reads whole splits of a file in order. A line's place is the sum of the splits before its own, which are summed up first, and of the lines before it there.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumn("size", F.octet_length("line").cast("long") + 1)
    sizes = raw.groupBy("file", "split").agg(F.sum("size").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = raw.withColumn("inside", inside).join(sizes.select("file", "split", before.alias("before")), ["file", "split"])
    return met.select((F.col("before") + F.col("inside")).alias("at"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines (at, line) to a new folder, whose files by name are the lines in the order of `at`. Every line ends with a line feed."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.option("lineSep", "\n").text(path)
