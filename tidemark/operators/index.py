"""A kept inverted index: postings stored by slice and term bucket, and exact top-k search that skips blocks by their bounds.

The chunks of a slice are dealt over ranges of about `BLOCK` chunks by a hash of chunk_id. A stored row has the postings of one term in one range: chunk ids, occurrences
and lengths, with their number, the most occurrences and the least length. As ranges are the same for all terms, a query's blocks line up: a range without one of
its terms can hold no answer, and the sum of its blocks' bounds is a bound of the range. Search reads these numbers first, scores each query's most promising
ranges, and from then on only ranges whose bound reaches the k-th best score so far. No answer is lost, ties included.

The words of a text move once, to the task of their range, where they are counted and blocks are made; the blocks of a range and bucket move once more, packed in one row, to the
files of their slice and bucket. A search moves the asked blocks to the task of their range, where they meet all queries: what is shuffled grows with the asked blocks, and not with queries times chunks.

A term that is in every chunk is as many rows as there are ranges, so no task holds a term. Tables are written by snapshot commits: a slice is replaced with its
postings and sizes at once, and no other slice's files are touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidemark.functions.stem import porter
from tidemark.functions.text import STOP_WORDS, words
from tidemark.operators import snapshots
from tidemark.operators.lineage import SENT_SIZES, cut
from tidemark.operators.search import SENT_TERMS, query_terms, ranked

#: Buckets of terms in each slice; chunks of a range; ranges that each query scores before its bound is known; asked terms that are pushed into the scan; characters whose words one task counts at once; asked postings, once for each query, that one task meets.
BUCKETS, BLOCK, SEEDS, PUSHED, TASK_CHARS, TASK_POSTINGS = 8, 128, 2, 1_000, 4_000_000, 1_000_000
SLICE = ("corpus", "doc_version")


def bucket(term: Column) -> Column:
    """CRC-32, which the tasks that pack the blocks of a range know as well."""
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _counted(text: Column) -> Column:
    """The words of a text that count; null is empty."""
    return F.filter(words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(*STOP_WORDS))


def _ranged(chunks: DataFrame) -> DataFrame:
    """The sorted words of each chunk that has some, with its range; all chunks of a range in one partition. Long texts make more ranges, so that none is much more than TASK_CHARS."""
    slices = cut(chunks.groupBy(*SLICE).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")))
    tasks = math.ceil((slices.agg(F.sum("chars")).first()[0] or 0) / TASK_CHARS)
    ranges = F.greatest(F.ceil(F.col("n") / BLOCK), F.coalesce(F.ceil(F.col("chars") / TASK_CHARS), F.lit(0)))
    sizes = slices.select(*(F.col(c).alias(f"__{c}") for c in SLICE), ranges.alias("__ranges"))
    sizes = F.broadcast(sizes) if sizes.limit(SENT_SIZES + 1).count() <= SENT_SIZES else sizes
    same = F.lit(True)
    for c in SLICE:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    said = chunks.withColumn("said", F.array_join(F.sort_array(_counted(F.col("content"))), " ")).filter("said != ''")
    placed = said.join(sizes, same).select(*SLICE, "chunk_id", "said", F.pmod(F.xxhash64("chunk_id"), F.col("__ranges")).alias("range"))
    return placed.repartition(max(tasks, 1), *SLICE, "range")


def _bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the greatest needs; `_numbers` reads them, given how many there are."""
    return numbers.astype(np.min_scalar_type(numbers.max())).tobytes()


def _numbers(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, f"u{len(held) // n}").astype(np.int64)


#: A range's postings of one bucket in a row: its terms, how many chunks each is in, and for each of these its place in chunk_ids and the occurrences.
_PACKED = "range long, bucket int, terms string, n binary, at binary, tf binary"


def _packed(ranged: DataFrame, stem: bool) -> DataFrame:
    """A row for each range and bucket of `_ranged`."""
    schema = StructType([f for f in ranged.schema if f.name in SLICE] + StructType.fromDDL(_PACKED).fields).add("chunk_ids", ArrayType(ranged.schema["chunk_id"].dataType)).add("lengths", ArrayType(IntegerType()))

    def pack(chunks: pa.Table) -> pa.Table:
        ids = chunks["chunk_id"].combine_chunks()
        own = np.arange(len(ids))
        if not pa.types.is_nested(ids.type):
            ids = ids.dictionary_encode("encode")
            own, ids = ids.indices.to_numpy(), ids.dictionary
        said = pc.split_pattern(chunks["said"].combine_chunks(), " ")
        at = own[pc.list_parent_indices(said).to_numpy()]
        said = pc.list_flatten(said).dictionary_encode()
        which, terms = said.indices.to_numpy(), said.dictionary
        if stem:
            stems = pa.array(map(porter, terms.to_pylist()), "string").dictionary_encode()
            which, terms = stems.indices.to_numpy()[which], stems.dictionary
        order = pc.sort_indices(terms).to_numpy()
        terms = terms.take(order).to_pylist()
        posting, tf = np.unique(np.argsort(order)[which].astype(np.int64) * len(ids) + at, return_counts=True)
        which, place = np.divmod(posting, len(ids))
        dealt, n = np.array([crc32(t.encode()) % BUCKETS for t in terms]), np.bincount(which)
        buckets = np.unique(dealt)
        first = pa.array(np.zeros(len(buckets), np.int64))
        alike = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], "int32"), values).take(first)
        each = [(" ".join(terms[i] for i in np.flatnonzero(here)), _bytes(n[here]), _bytes(place[here[which]]), _bytes(tf[here[which]])) for here in (dealt == b for b in buckets)]
        out = {c: chunks[c].take(first) for c in (*SLICE, "range")} | {"bucket": pa.array(buckets, "int32")}
        out |= {c: pa.array(values, kind) for (c, kind), values in zip((("terms", "string"), ("n", "binary"), ("at", "binary"), ("tf", "binary")), zip(*each, strict=True), strict=True)}
        return pa.table(out | {"chunk_ids": alike(ids), "lengths": alike(pa.array(np.bincount(at, minlength=len(ids)), "int32"))}).select(schema.names)

    return ranged.groupBy(*SLICE, "range").applyInArrow(pack, schema)


def _blocks(packed: DataFrame) -> DataFrame:
    """A row for each term and range of `_packed`."""
    entry = StructType().add("chunk_id", packed.schema["chunk_ids"].dataType.elementType).add("tf", "integer").add("length", "integer")
    schema = StructType([f for f in packed.schema if f.name in SLICE]).add("term", "string").add("range", "long").add("n", "long").add("most", "integer").add("least", "integer").add("entries", ArrayType(entry)).add("bucket", "integer")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("terms", "n", "at", "tf", "chunk_ids", "lengths")}
                terms = row["terms"].as_py().split(" ")
                n = _numbers(row["n"].as_py(), len(terms))
                ends = np.cumsum(n)
                at, tf = (_numbers(row[c].as_py(), ends[-1]) for c in ("at", "tf"))
                length = row["lengths"].values.to_numpy()[at]
                parts = [row["chunk_ids"].values.take(pa.array(at)), pa.array(tf, "int32"), pa.array(length, "int32")]
                entries = pa.ListArray.from_arrays(pa.array(np.append(0, ends), "int32"), pa.StructArray.from_arrays(parts, names=entry.names))
                made = {"term": pa.array(terms, "string"), "n": pa.array(n), "most": pa.array(np.maximum.reduceat(tf, ends - n), "int32"), "least": pa.array(np.minimum.reduceat(length, ends - n), "int32"), "entries": entries}
                here = pa.array(np.full(len(terms), i))
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).take(here) for f in schema], names=schema.names)

    return packed.mapInArrow(unpack, schema)


def index_tables(chunks: DataFrame, stem: bool = True) -> dict[str, DataFrame]:
    """`postings` and `sizes` of chunks (corpus, doc_version, chunk_id, content); chunk ids of any type, each once in a slice. Chunks without a word count in a slice's size and are in no posting. Null contents are empty."""
    dealt = _blocks(_packed(_ranged(chunks), stem).hint("rebalance", *SLICE, "bucket")).sortWithinPartitions(*SLICE, "bucket", "term", "range")
    length = F.size(_counted(F.col("content"))).cast("long")
    return {"postings": dealt, "sizes": chunks.groupBy(*SLICE).agg(F.count("*").alias("chunks"), F.sum(length).alias("words"))}


def index_slices(chunks: DataFrame, folder: str, stem: bool = True) -> int:
    """Indexes the slices of `chunks` in place of what the index has of them, in one commit; gives its snapshot."""
    return snapshots.commit(index_tables(chunks, stem), folder, SLICE, {"postings": ("bucket",)}, {"postings": chunks.filter(F.size(_counted(F.col("content"))) > 0), "sizes": chunks})


@dataclass(frozen=True)
class Collection:
    """What a score may use of the searched slices."""

    chunks: int
    words: int


#: (occurrences, length, chunks with the term, the collection) to a term's part of a score, which must grow with occurrences and not with length: bounds come from the most occurrences and the least length.
Score = Callable[[Column, Column, Column, Collection], Column]


def occurrences(tf: Column, length: Column, df: Column, of: Collection) -> Column:
    return tf.cast("double")


def bm25(tf: Column, length: Column, df: Column, of: Collection, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(F.lit(1.0) + (F.lit(float(of.chunks)) - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / (of.words / max(of.chunks, 1))))


@dataclass(frozen=True)
class Found:
    """`rows` (query_id, chunk_id, score, rank, and the slice), and how many postings of the asked terms there are and were scored, counted when they are looked at."""

    rows: DataFrame
    count_asked: Callable[[], int]
    count_scored: Callable[[], int]

    @cached_property
    def asked(self) -> int:
        return self.count_asked()

    @cached_property
    def scored(self) -> int:
        return self.count_scored()


def search(queries: DataFrame, folder: str, k: int, score: Score = bm25, corpus: str | None = None, doc_version: str | None = None, stem: bool = True, snapshot: int | None = None) -> Found:
    """The k chunks of the greatest score among those that hold every term of a query (query_id, query), of a corpus and version or of all; ties by chunk_id. A query of stop words matches nothing.

    Scores are rounded to nine digits, within which sums of the same parts in another order are equal.
    """
    spark = queries.sparkSession
    asked = cut(query_terms(queries, stem))
    scope = _scope(spark, folder, corpus, doc_version, snapshot)
    size = scope("sizes").agg(F.sum("chunks").alias("chunks"), F.sum("words").alias("words")).first()
    of = Collection(size["chunks"] or 0, size["words"] or 0)
    blocks = asked_blocks(scope("postings"), asked).withColumn("slice", snapshots.slice_key(SLICE))
    place = ["slice", "range"]
    met = cut(asked.join(blocks.groupBy("term").agg(F.sum("n").alias("df")), "term"))
    need = asked.groupBy("query_id").agg(F.count("*").alias("need")).join(met.groupBy("query_id").agg(F.count("*").alias("have")), "query_id").filter("have = need")
    wanted = cut(met.join(need.drop("have"), "query_id"))
    total = lambda some, n="n": some.agg(F.sum(n)).first()[0] or 0
    tasks = max(math.ceil(total(wanted, "df") / TASK_POSTINGS), spark.sparkContext.defaultParallelism)
    best = [F.desc("score"), F.col("chunk_id"), *map(F.col, SLICE)]
    near = (F.round("bound", 9) + 2e-9).alias("bound")

    def bounded(by: DataFrame, *kept: str) -> DataFrame:
        """The asked blocks of all queries, those of a range in one partition: a block moves once, and meets its queries there."""
        moved = blocks.select(*place, "term", "n", "most", "least", *kept).repartition(tasks, *place)
        return moved.join(_sent(by), "term").withColumn("bound", score(F.col("most"), F.col("least"), F.col("df"), of))

    def scored(parts: DataFrame, *by: str) -> DataFrame:
        """(query_id, slice, chunk_id, score) of all chunks of these blocks that hold every term; `by` goes with a query and range."""
        each = parts.select("query_id", "need", *SLICE, *place, *by, "df", F.explode("entries").alias("e"))
        one = each.select("query_id", "need", *SLICE, *place, *by, F.col("e.chunk_id").alias("chunk_id"), score(F.col("e.tf"), F.col("e.length"), F.col("df"), of).alias("part"))
        whole = one.groupBy("query_id", "need", *SLICE, *place, *by, "chunk_id").agg(F.count("*").alias("have"), F.sum("part").alias("score")).filter("have = need")
        return whole.select("query_id", *SLICE, "chunk_id", *by, F.round("score", 9).alias("score"))

    spots = bounded(wanted).groupBy("query_id", "need", *place).agg(F.count("*").alias("have"), F.sum("bound").alias("bound"), F.sum("n").alias("n")).filter("have = need")
    seeds = cut(ranked(spots.select("query_id", *place, "n", near), SEEDS, F.desc("bound"), *map(F.col, place)))
    first = blocks.join(_sent(cut(seeds.select("query_id", *place).join(wanted, "query_id"))), [*place, "term"])
    order = F.struct((-F.col("score")).alias("score"), "chunk_id", *SLICE)
    least = ranked(scored(first), k, *best).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"), order.alias("last"))
    known = cut(wanted.join(least, "query_id", "left"))
    whole = Window.partitionBy("query_id", *place)
    reaches = "have = need and (reached is null or bound >= reached)"
    rest = bounded(known, *SLICE, "entries").withColumns({"have": F.count("*").over(whole), "bound": F.sum("bound").over(whole)}).withColumn("bound", near).filter(reaches)
    rows = ranked(scored(rest, "last").filter(F.col("last").isNull() | (order <= F.col("last"))).drop("last"), k, *best)

    def read() -> int:
        late = bounded(known).groupBy("query_id", "need", "reached", *place).agg(F.count("*").alias("have"), F.sum("bound").alias("bound"), F.sum("n").alias("n")).withColumn("bound", near)
        return total(late.filter(reaches)) + total(seeds.join(known.select("query_id", "reached").distinct(), "query_id").filter("bound < reached"))

    return Found(rows, lambda: total(met, "df"), read)


def _sent(rows: DataFrame) -> DataFrame:
    """Stored rows, marked to be sent to all tasks if there are at most SENT_TERMS."""
    return F.broadcast(rows) if rows.limit(SENT_TERMS + 1).count() <= SENT_TERMS else rows


def asked_blocks(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `postings` for the terms of asked (term). Only files of their buckets are read; up to PUSHED terms are pushed into the scan, more are sent to the tasks that read, beyond SENT_TERMS joined by shuffle."""
    terms = asked.select("term").distinct()
    here = stored.filter(F.col("bucket").isin(sorted(r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect())))
    few = [r["term"] for r in terms.limit(PUSHED + 1).collect()]
    return here.filter(F.col("term").isin(few)) if len(few) <= PUSHED else here.join(_sent(terms), "term", "left_semi")


def _scope(spark: SparkSession, folder: str, corpus: str | None, doc_version: str | None, snapshot: int | None) -> Callable[[str], DataFrame]:
    number = snapshots.latest(spark, folder) if snapshot is None else snapshot

    def table(name: str) -> DataFrame:
        rows = snapshots.read(spark, folder, name, number)
        rows = rows if corpus is None else rows.filter(F.col("corpus") == corpus)
        return rows if doc_version is None else rows.filter(F.col("doc_version") == doc_version)

    return table
