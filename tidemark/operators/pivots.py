"""Exact vector search for many queries: tiles of chunks around pivots, pruned by the triangle inequality.

Vectors of length 1 have a cosine similarity of c where their distance is sqrt(2 - 2c), and distances are a metric. Every chunk goes to its nearest pivot and there to a
ring by its distance; a tile is a ring of a pivot. A query at distance d of a pivot is no nearer to a chunk of the ring [lo, hi] than max(d - hi, lo - d). Each
query first meets the tiles of least bounds that hold k chunks; its k-th best distance there is a bound for all others, and tiles that
can't reach it are neither shuffled nor multiplied with that query. What is left out can't be an answer, so rows are those of a full product.

Pivots are fitted on a bounded sample; how good they are decides what is saved, not what is found. Tables of tiles have at most pivots times rings rows. A large tile is
dealt over several groups, and so are the queries of a tile; a group holds its queries and its chunks pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.search import Best, best_kinds, ids_of, ranked, unit_vectors

#: Rows of the sample for each pivot, rounds of its fit, and rings from distance 0 to 2.
SAMPLE, ROUNDS, RINGS = 32, 4, 32
#: Chunks and queries of a group.
GROUP_CHUNKS, GROUP_QUERIES = 500_000, 16_384
#: Distances that rounding may move.
SLACK = 1e-7


@dataclass(frozen=True)
class Pruned:
    """`rows` (query_id, chunk_id, similarity, rank), and how many products of a query and a chunk there are in all and were made."""

    rows: DataFrame
    pairs: int
    products: int


def fit_pivots(usable: DataFrame, pivots: int) -> np.ndarray:
    """Centres of a sample of at most SAMPLE rows a pivot, drawn by a hash of the id: the same on every run."""
    drawn = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE * pivots).select("embedding").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 1))
    x = unit_vectors(drawn.column(0).combine_chunks())
    x = x[np.isfinite(x).all(axis=1)]
    centres = x[:pivots].copy()
    for _ in range(ROUNDS if len(x) > pivots else 0):
        near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _placed(usable: DataFrame, centres: np.ndarray) -> DataFrame:
    """(chunk_id, embedding, tile, distance) of every vector that isn't zero."""
    names = ["chunk_id", "embedding", "tile", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_096):
                part = batch.slice(lo, 4_096)
                x = unit_vectors(part.column("embedding"))
                there = np.flatnonzero(np.isfinite(x).all(axis=1))
                if not len(there):
                    continue
                d = distances(x[there], centres)
                cell = d.argmin(axis=1)
                near = d[np.arange(len(there)), cell]
                tile = cell * (RINGS + 1) + np.minimum((near * (RINGS / 2)).astype(np.int64), RINGS)
                kept = part.take(pa.array(there))
                yield pa.RecordBatch.from_arrays([kept.column("chunk_id"), kept.column("embedding"), pa.array(tile), pa.array(near)], names=names)

    kinds = ", ".join(f"{c} {k}" for c, k in usable.dtypes)
    return usable.select("chunk_id", "embedding").mapInArrow(run, f"{kinds}, tile long, distance double")


def _bounds(x: np.ndarray, centres: np.ndarray, tiles: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least distance that each row may have to a chunk of each tile."""
    d = distances(x, centres)[:, tiles // (RINGS + 1)]
    return np.maximum(np.maximum(d - hi, lo - d), 0) - SLACK


def _asking(asked: DataFrame, centres: np.ndarray, tiles: dict[str, np.ndarray], k: int, seeds: bool) -> DataFrame:
    """(query_id, embedding, tile) of the tiles that a query meets: at first those of least bounds that hold k chunks together, then others whose bound is within its `reach`."""
    names = ["query_id", "embedding", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_024):
                part = batch.slice(lo, 1_024)
                if not len(tiles["n"]):
                    continue
                x = unit_vectors(part.column("embedding"))
                usable = np.isfinite(x).all(axis=1)
                bound = _bounds(np.nan_to_num(x), centres, tiles["tile"], tiles["lo"], tiles["hi"])
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(tiles["n"][order], axis=1) - tiles["n"][order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                if not seeds:
                    reach = part.column("reach").to_numpy(zero_copy_only=False).astype(float)
                    first = ~first & (bound <= np.where(np.isnan(reach), np.inf, reach)[:, None])
                row, tile = np.nonzero(first & usable[:, None])
                kept = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([kept.column("query_id"), kept.column("embedding"), pa.array(tiles["tile"][tile])], names=names)

    kinds = ", ".join(f"{c} {kind}" for c, kind in asked.dtypes if c != "reach")
    return asked.mapInArrow(run, f"{kinds}, tile long")


def _met(asking: DataFrame, placed: DataFrame, sizes: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The k best chunks of each query and group among the tiles that it asks for, and the number of products."""
    asking = cut(asking)
    wanted = cut(asking.groupBy("tile").agg(F.count("*").alias("asked")).join(sizes, "tile"))
    products = wanted.agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
    parts = wanted.select("tile", F.ceil(F.col("asked") / GROUP_QUERIES).cast("int").alias("blocks"), F.ceil(F.col("n") / GROUP_CHUNKS).cast("int").alias("slices"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    query = asking.join(parts, "tile").select("tile", slot("query_id", "blocks").alias("block"), every("slices").alias("slice"), F.lit(0).alias("role"), "query_id", F.lit(None).cast(placed.schema["chunk_id"].dataType).alias("chunk_id"), "embedding")
    chunk = placed.join(parts, "tile").select("tile", every("blocks").alias("block"), slot("chunk_id", "slices").alias("slice"), F.lit(1).alias("role"), F.lit(None).cast(asking.schema["query_id"].dataType).alias("query_id"), "chunk_id", "embedding")
    place = ["tile", "block", "slice"]
    dealt = query.unionByName(chunk).repartition(*place).sortWithinPartitions(*place, "role")
    schema, arrow, kind = best_kinds(asking, placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy() for c in (*place, "role")])
            edges = [*np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1))), len(where)] if len(where) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if group != tuple(where[i, :3]):
                    if best is not None:
                        yield best.rows(arrow)
                    group, held, best = tuple(where[i, :3]), [], None
                part = batch.slice(i, j - i)
                if where[i, 3] == 0:
                    held.append((part.column("query_id"), unit_vectors(part.column("embedding"))))
                elif held:
                    best = best or Best(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), k, kind)
                    best.meet(ids_of(part.column("chunk_id")), unit_vectors(part.column("embedding")))
        if best is not None:
            yield best.rows(arrow)

    return dealt.mapInArrow(run, schema), products


def pruned_topk(queries: DataFrame, chunks: DataFrame, k: int, pivots: int = 64) -> Pruned:
    """The k chunks of greatest cosine similarity of every query (query_id, embedding), ties by chunk_id, with most products of the two tables left out. Null and zero vectors match nothing."""
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    usable = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    centres = fit_pivots(usable, pivots)
    placed = cut(_placed(usable, centres))
    sizes = cut(placed.groupBy("tile").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")))
    found = sizes.orderBy("tile").toArrow()
    tiles = {c: found.column(c).to_numpy() for c in ("tile", "n", "lo", "hi")}
    sizes = sizes.select("tile", "n")
    first, made = _met(_asking(asked, centres, tiles, k, True), placed, sizes, k)
    first = cut(ranked(first, k, F.desc("similarity"), F.col("chunk_id")))
    least = first.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(2.0) - 2 * F.col("similarity"), F.lit(0.0))).alias("reach"))
    more, rest = _met(_asking(asked.join(least, "query_id", "left"), centres, tiles, k, False), placed, sizes, k)
    rows = ranked(first.drop("rank").unionByName(more), k, F.desc("similarity"), F.col("chunk_id"))
    return Pruned(rows, asked.count() * int(tiles["n"].sum()), made + rest)
