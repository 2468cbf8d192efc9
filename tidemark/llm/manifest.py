"""Merkle manifest of a dataset: a root digest for all documents, and proofs that a document is one of them.

Every document is a leaf, every language a binary tree over its leaves in the order of doc_id, and one more tree over the
languages' subroots gives the root. Only every few levels are stored (checkpoints), as rows of aligned subtrees: `2 ** every` consecutive
nodes with their common ancestor some levels up. A proof needs the levels between, and they are recomputed: each stored subtree
is folded again from its own nodes in the task that reads it, gives every node its siblings, and is discarded. Proofs run from the top
down, so what stands above a subtree is made once for all of its nodes.

`H` is the lowercase hex SHA-256 of its inputs put together, digests as hex text. Two consecutive nodes become their H, and a last single one its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import batched

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, numbered

#: Levels from one stored level to the next; subtrees that are read back at once.
EVERY, SUBTREES = 6, 32

_PATH = "siblings array<string>, left array<boolean>, subroot binary"


def field(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, siblings: Column, left: Column) -> Column:
    """The root that a leaf gives with its siblings, level by level: null where a node is single, `left` where the sibling comes first."""
    step = lambda node, x: F.sha2(F.when(x["siblings"].isNull(), node).when(x["left"], F.concat(x["siblings"], node)).otherwise(F.concat(node, x["siblings"])), 256)
    return F.aggregate(F.arrays_zip(siblings.alias("siblings"), left.alias("left")), leaf, step)


def regenerated(nodes: list[str], block: int, every: int) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes up to their ancestor. Only the first subtree of a tree can be the tree's last one, and then ends with the tree's root."""
    out = [nodes]
    for _ in range((len(nodes) - 1).bit_length() if block == 0 else every):
        out.append([sha256("".join(run).encode()).hexdigest() for run in batched(out[-1], 2)])
    return out


def _subtrees(nodes: DataFrame, every: int) -> DataFrame:
    """(tree, block, digests, items) of nodes (tree, pos, digest, item): rows of up to 2 ** every nodes in their order."""
    together = F.array_sort(F.collect_list(F.struct("pos", "digest", "item")))
    rows = nodes.groupBy("tree", F.shiftright("pos", every).alias("block")).agg(together.alias("nodes"))
    return rows.select("tree", "block", F.col("nodes.digest").alias("digests"), F.col("nodes.item").alias("items"))


def _ancestors(subtrees: DataFrame, every: int) -> DataFrame:
    """The nodes `every` levels above: (tree, pos, digest, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, top = batch.column("block"), []
            for block, digests in zip(blocks.to_pylist(), batch.column("digests"), strict=True):
                top.append(bytes.fromhex(regenerated([d.hex() for d in digests.as_py()], block, every)[-1][0]))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), blocks, pa.array(top, pa.binary())], names=["tree", "pos", "digest"])

    return subtrees.select("tree", "block", "digests").mapInArrow(run, "tree string, pos long, digest binary").withColumn("item", F.lit(None).cast("int"))


_DONE, _GOING = "block = 0 and size(digests) = 1", "not (block = 0 and size(digests) = 1)"


def _store(nodes: DataFrame, folder: str, every: int) -> list[DataFrame]:
    """Writes the stored levels of a forest, nodes (tree, pos, digest, item), and gives them; a tree ends where it has a single node above its leaves."""
    spark, levels = nodes.sparkSession, []
    while True:
        path = f"{folder}/level={len(levels) * every}"
        _subtrees(nodes, every).write.parquet(path)
        levels.append(spark.read.parquet(path))
        going = levels[-1].filter(_GOING) if len(levels) > 1 else levels[-1]
        if going.isEmpty():
            return levels
        nodes = _ancestors(going, every)


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree of a forest."""
    ends = [level.filter(_DONE).select("tree", F.col("digests")[0].alias("digest")) for level in levels[1:]]
    out = ends[0] if ends else levels[0].select("tree", F.col("digests")[0].alias("digest")).limit(0)
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def _with_siblings(subtrees: DataFrame, above: DataFrame, every: int) -> DataFrame:
    """Every node (tree, pos, digest, item) of the subtrees with its siblings up to the root: its own subtree's, which are regenerated, and those of `above` (tree, pos, siblings, left, subroot)."""
    met = subtrees.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    item = subtrees.schema["items"].dataType.elementType.simpleString()
    columns = ["tree", "pos", "digest", "item", "siblings", "left", "subroot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SUBTREES):
                part = batch.slice(lo, SUBTREES)
                pos, siblings, left = [], [], []
                for block, digests, over, over_left in zip(*(part.column(c).to_pylist() for c in ("block", "digests", "siblings", "left")), strict=True):
                    levels = regenerated([d.hex() for d in digests], block, every)[:-1]
                    for i in range(len(digests)):
                        pos.append((block << every) + i)
                        siblings.append([nodes[i >> h ^ 1] if i >> h ^ 1 < len(nodes) else None for h, nodes in enumerate(levels)] + over)
                        left.append([bool(i >> h & 1) for h in range(len(levels))] + over_left)
                of = pc.list_parent_indices(part.column("digests"))
                flat = [part.column("tree").take(of), pa.array(pos, pa.int64()), part.column("digests").flatten(), part.column("items").flatten()]
                yield pa.RecordBatch.from_arrays([*flat, pa.array(siblings, pa.list_(pa.string())), pa.array(left, pa.list_(pa.bool_())), part.column("subroot").take(of)], names=columns)

    return met.select("tree", "block", "digests", "items", "siblings", "left", "subroot").mapInArrow(run, f"tree string, pos long, digest binary, item {item}, {_PATH}")


def _proved(levels: list[DataFrame], roots: DataFrame, every: int) -> DataFrame:
    """All leaves of a forest with what proves them. `roots` has (tree, siblings, left, subroot): what stands above each tree."""
    columns = ["tree", "pos", "siblings", "left", "subroot"]
    nodes = roots.withColumn("pos", F.lit(0).cast("long")).select(*columns)
    for level in reversed(levels[1:]):
        ends = level.filter(_DONE).select("tree", F.lit(0).cast("long").alias("pos")).join(roots, "tree").select(*columns)
        nodes = ends if level is levels[-1] else _with_siblings(level.filter(_GOING), nodes, every).select(*columns).unionByName(ends)
    return _with_siblings(levels[0], nodes, every)


def write_manifest(docs: DataFrame, folder: str, keep: dict[str, Column] | None = None, every: int = EVERY) -> None:
    """Writes the manifest of `docs` (doc_id, source, lang, n_chars, text) to `folder`, a new one: stored levels of the languages' trees (`languages`) and of the tree above them (`top`).

    Documents with one doc_id stand in the order of their digests, so that the root is the same however the rows are read; repeated rows are leaves
    each, a null id comes first, and so does the tree of documents without a language. A null is not an empty text. Texts are hashed whole, whatever
    their length. Without a row nothing is written but empty levels. `keep` names further columns of `docs` that come back with a leaf's proof. Other
    columns are not read. Rows are sorted by range over (language, doc_id, digest), so no task holds a language, and a task's memory is that of its subtrees.
    """
    keep, given = keep or {}, [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    item = F.struct(F.col("doc_id"), *(c.alias(name) for name, c in keep.items()))
    leaves = cut(docs.select(tree.alias("tree"), F.unhex(leaf_digest(*given)).alias("digest"), item.alias("item")))
    placed = numbered(leaves, F.col("item.doc_id"), F.col("digest"), column="pos", by="tree")
    roots = _roots(_store(placed.withColumn("pos", F.col("pos") - 1), f"{folder}/languages", every))
    order = numbered(roots, F.col("tree"), column="pos")
    _store(order.select(F.lit("").alias("tree"), F.col("pos") - 1, "digest", F.col("tree").alias("item")).toDF("tree", "pos", "digest", "item"), f"{folder}/top", every)


def _stored(spark: SparkSession, folder: str, every: int) -> list[DataFrame]:
    last = spark.read.schema("block long, level int").parquet(folder).agg(F.max("level")).first()[0] or 0
    return [spark.read.parquet(f"{folder}/level={at}") for at in range(0, last + 1, every)]


def proofs(spark: SparkSession, folder: str, every: int = EVERY) -> DataFrame:
    """(doc_id, lang, pos, leaf, subroot, root, siblings, left, and what was kept) of every document of a manifest that was written with the same `every`.

    `siblings` leads from the leaf through its language's subroot to the root, with a null where a node is single; `left` tells which come first.
    """
    top, languages = (_stored(spark, f"{folder}/{name}", every) for name in ("top", "languages"))
    none = "cast(array() as array<string>) as siblings", "cast(array() as array<boolean>) as left"
    root = _roots(top).selectExpr("tree", *none, "digest as subroot")
    above = _proved(top, root, every).select(F.col("item").alias("tree"), "siblings", "left", F.col("digest").alias("subroot"), F.col("subroot").alias("root"))
    found = _proved(languages, above.drop("root"), every)
    text = lambda c: F.lower(F.hex(c))
    end = _roots(top).first()
    lang = F.when(F.col("tree") != "-", F.expr("substr(tree, 2)"))
    return found.select("item.*", lang.alias("lang"), "pos", text("digest").alias("leaf"), text("subroot").alias("subroot"), F.lit(end["digest"].hex() if end else None).cast("string").alias("root"), "siblings", "left")


def proof_digest(siblings: Column) -> Column:
    """H of the siblings, left to right."""
    return F.sha2(F.array_join(siblings, ""), 256)
