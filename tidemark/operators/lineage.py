"""Lineage cuts in the shared folder that the cluster names, and row numbers over a distributed sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a table of sizes that is sent to all tasks.
SENT_SIZES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one that the session names; in local mode without one, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder; later reads don't compute it again and outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, *order: Column, column: str = "ord", by: str | None = None) -> DataFrame:
    """`rows` with their 1-based place in a total order, within each value of `by` if that is given.

    Rows are sorted by range over all partitions and written once; a partition's numbers begin where those before it end, so no task sees more than its range.
    Nulls of `by` are one value. The sizes, a row for each partition and value in it, are sent to all tasks up to SENT_SIZES rows and joined by shuffle beyond.
    """
    keys = [F.col(by), *order] if by else list(order)
    stored = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    group = F.col(by) if by else F.lit(0)
    sizes = stored.groupBy("__part", group.alias("__group")).agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(sizes.select(F.col("__part").alias("__in"), F.col("__group").alias("__of"), "__first", F.coalesce(before, F.lit(0)).alias("__before")))
    starts = F.broadcast(starts) if starts.limit(SENT_SIZES + 1).count() <= SENT_SIZES else starts
    met = stored.withColumn("__group", group).join(starts, (F.col("__part") == F.col("__in")) & F.col("__group").eqNullSafe(F.col("__of")))
    return met.withColumn(column, F.col("__before") + F.col("__row") - F.col("__first") + 1).select(*rows.columns, column)
