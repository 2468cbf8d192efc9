"""Connected components of an edge table by alternating star contraction.

Every round hangs the larger neighbours of a node, then the smaller ones, on the least neighbour.
Minima are combined before the shuffle, and rounds are logarithmic in practice; no component is
ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: Edges a task; smaller tables are kept in fewer partitions than a session's default.
ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a and b, any order, loops and repeats allowed) but the roots; root is the least node of the component."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        few = max(1, -(-mark[0] // ROWS))
        now = now.coalesce(few)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(2 * few).distinct().coalesce(2 * few))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.withColumnRenamed("m", "b"))
        now = cut(small.coalesce(2 * few).distinct().coalesce(2 * few))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)).alias("s")).first()
    return row["n"], row["s"] or 0
