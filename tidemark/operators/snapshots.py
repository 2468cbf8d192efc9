"""Snapshots of sliced tables: several tables change in one commit, and readers follow a manifest that is written last.

A table is cut into slices by its key columns. A commit writes the new slices of all its tables to folders of their own and then one small file, the
manifest of the next snapshot: which commit holds each slice of each table. Until that file is in its place, readers see the snapshot before, and a
commit that stops half way leaves files that no snapshot names. Earlier snapshots stay readable until `expire` lets them go.

    <folder>/data/<table>/__commit=<token>/<key>=<value>/...    written once, never changed
    <folder>/snapshots/snapshot=<number>/part-*.json            a row for each slice

A manifest is as large as the list of slices; rows of tables never pass through the driver. One writer at a time: a second one that has started from
the same snapshot fails when it finds the number taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.lineage import cut

_MANIFEST = "name string, slice string, rows long, token string, slices long, keys array<string>, kind string, snapshot int"


def slice_key(keys: tuple[str, ...]) -> Column:
    """A slice's key values as one text; nulls are values."""
    return F.concat_ws("\u0001", *(F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys))


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/snapshots")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the last snapshot; 0 if there is none."""
    return _manifests(spark, folder).agg(F.max("snapshot")).first()[0] or 0


def write_slices(rows: DataFrame, folder: str, name: str, keys: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Writes the slices of one table under a token that no snapshot names yet, and gives their manifest rows. `within` cuts a slice's files further."""
    token, at = uuid.uuid4().hex, f"{folder}/data/{name}"
    rows.write.partitionBy(*keys, *within).parquet(f"{at}/__commit={token}")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/__commit={token}")
    kind = F.lit(rows.schema.json())
    found = stored.groupBy(*keys).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), slice_key(keys).alias("slice"), "rows", F.lit(token).alias("token"))
    return cut(found.select("*", F.lit(found.count()).cast("long").alias("slices"), F.array(*map(F.lit, keys)).alias("keys"), kind.alias("kind")))


def rows_of(spark: SparkSession, folder: str, snapshot: int) -> DataFrame:
    """(name, slice, rows) of a snapshot, from its manifest."""
    return _manifests(spark, folder).filter(F.col("snapshot") == snapshot).select("name", "slice", "rows")


def publish(entries: DataFrame, folder: str, base: int) -> int:
    """Writes the manifest that follows snapshot `base`, with `entries` in place of the slices that they name, and gives its number."""
    spark = entries.sparkSession
    before = _manifests(spark, folder)
    if (last := before.agg(F.max("snapshot")).first()[0] or 0) != base:
        raise RuntimeError(f"snapshot {last} has come after {base}, which this commit has started from")
    kept = before.filter(F.col("snapshot") == base).drop("snapshot").join(entries.select("name", "slice"), ["name", "slice"], "left_anti")
    whole = kept.unionByName(entries).coalesce(1)
    for number in range(base + 1, base + 100):
        try:
            whole.write.mode("errorifexists").json(f"{folder}/snapshots/snapshot={number}")
            return number
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS" or latest(spark, folder) >= number:
                raise
    raise RuntimeError(f"no free number after {base}")


def commit(tables: dict[str, DataFrame], folder: str, keys: tuple[str, ...] = ("corpus", "doc_version"), within: dict[str, tuple[str, ...]] | None = None, sources: dict[str, DataFrame] | None = None) -> int:
    """Replaces the slices that `tables` hold, of all of them at once, leaves other slices alone and gives the new snapshot's number. A table without a row fails before anything is written.

    `sources` may give, for a table that is dear to make, rows that are there exactly if it has some: these are looked at then, and the table is made only once.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        if (sources or {}).get(name, rows).isEmpty():
            raise ValueError(f"nothing to write to {name}: the stored slices stay as they are")
    base, entries = latest(spark, folder), None
    for name, rows in tables.items():
        more = write_slices(rows, folder, name, keys, (within or {}).get(name, ()))
        entries = more if entries is None else entries.unionByName(more)
    return publish(entries, folder, base)


def read(spark: SparkSession, folder: str, name: str, snapshot: int | None = None) -> DataFrame:
    """A table as a snapshot has it, the last one unless a number is given. Slices that a later commit has replaced are pruned as partitions and not read."""
    number = latest(spark, folder) if snapshot is None else snapshot
    rows = _manifests(spark, folder).filter((F.col("snapshot") == number) & (F.col("name") == name)).select("slice", "token", "slices", "keys", "kind").collect()
    if not rows:
        raise ValueError(f"snapshot {number} has no table {name}")
    schema = StructType.fromJson(json.loads(rows[0]["kind"]))
    tokens: dict[str, list] = {}
    for r in rows:
        tokens.setdefault(r["token"], []).append(r)
    at = f"{folder}/data/{name}"
    found = spark.read.schema(schema.add("__commit", "string")).option("basePath", at).parquet(*(f"{at}/__commit={t}" for t in sorted(tokens)))
    wanted, part = F.lit(False), False
    for token, own in sorted(tokens.items()):
        here = F.col("__commit") == token
        if len(own) < own[0]["slices"]:
            here, part = here & slice_key(tuple(own[0]["keys"])).isin(sorted(r["slice"] for r in own)), True
        wanted = wanted | here
    return (found.filter(wanted) if part else found).drop("__commit")


def expire(spark: SparkSession, folder: str, keep: int = 1) -> list[int]:
    """Deletes all but the last `keep` snapshots, and the files that none of the others names, of stopped commits too; gives the numbers that stay. Not to be run beside a commit."""
    every = _manifests(spark, folder)
    numbers = sorted(r[0] for r in every.select("snapshot").distinct().collect())
    stay = numbers[-keep:]
    named = {(r["name"], r["token"]) for r in every.filter(F.col("snapshot").isin(stay)).select("name", "token").distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number in numbers[:-keep]:
        files.delete(hadoop.Path(f"{folder}/snapshots/snapshot={number}"), True)
    for table in files.listStatus(hadoop.Path(f"{folder}/data")):
        for one in files.listStatus(table.getPath()):
            if (table.getPath().getName(), one.getPath().getName().removeprefix("__commit=")) not in named:
                files.delete(one.getPath(), True)
    return stay
