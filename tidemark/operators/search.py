"""Retrieval: exact cosine top-k, conjunctive keyword search, rank fusion, reranking, gates and contexts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.stem import stem_terms, stemmed
from tidemark.functions.text import STOP_WORDS, words
from tidemark.operators.lineage import cut

RRF_K = 60
#: Bytes of query vectors that are sent to the tasks; queries and chunks whose scores are made at once.
QUERY_BYTES, TILE = 64 << 20, 2_048
#: Rows of a table of words that is sent to all tasks.
SENT_TERMS = 500_000


def in_scope(chunks: DataFrame, corpus: str, doc_version: str | None = None) -> DataFrame:
    """The chunks of a corpus, of one version or of all."""
    scoped = chunks.filter(F.col("corpus") == corpus)
    return scoped if doc_version is None else scoped.filter(F.col("doc_version") == doc_version)


def ranked(rows: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k chunks of greatest cosine similarity, ties by chunk_id. Ids are of any type. Null and zero vectors match nothing.

    Up to QUERY_BYTES of query vectors are sent to all tasks, and chunks are read where they are. More queries meet the tiles of chunks that can hold
    one of their k best, see `tidemark.operators.pivots`. Either way only the k best of a query and partition are shuffled, and scores are made in tiles of a fixed size.
    """
    from tidemark.operators.pivots import pruned_topk

    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    usable = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] * (size["d"] or 1) * 8 > QUERY_BYTES:
        return pruned_topk(asked, usable, k).rows
    return ranked(_sent_topk(asked, usable, k), k, F.desc("similarity"), F.col("chunk_id"))


def unit_vectors(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1; a zero vector is not a number."""
    x = np.stack(vectors.to_numpy(zero_copy_only=False)).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, np.nan, norm)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids that numpy can order as Spark does: whole numbers as such, others as Python objects."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64 if pa.types.is_integer(column.type) else object)


class Best:
    """The k best chunks so far of a block of queries. Ids are whole numbers, or objects that can be ordered."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, kind: type):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.score, self.chunk = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), kind)

    def meet(self, chunk: np.ndarray, vectors: np.ndarray) -> None:
        there = np.isfinite(vectors).all(axis=1)
        chunk, vectors = (chunk, vectors) if there.all() else (chunk[there], vectors[there])
        for i in range(0, len(chunk), TILE):
            for q in range(0, len(self.ids), TILE):
                self._tile(slice(q, q + TILE), chunk[i : i + TILE], vectors[i : i + TILE])

    def _tile(self, rows: slice, chunk: np.ndarray, vectors: np.ndarray) -> None:
        score = self.matrix[rows] @ vectors.T
        least = self.score[rows, -1]
        near = score >= least[:, None]
        if len(chunk) > self.k and np.count_nonzero(near) > self.k * len(score):
            near &= score >= np.partition(score, len(chunk) - self.k, axis=1)[:, -self.k][:, None]
        row, at = np.divmod(np.flatnonzero(near), len(chunk))
        moved = np.unique(row)
        if not len(moved):
            return
        old, place = np.nonzero(np.isfinite(self.score[rows][moved]))
        old = moved[old]
        row, new_score, new_chunk = np.append(old, row), np.append(self.score[rows][old, place], score[row, at]), np.append(self.chunk[rows][old, place], chunk[at])
        order = np.lexsort((new_chunk if new_chunk.dtype != object else np.unique(new_chunk, return_inverse=True)[1], -new_score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.score[rows][row, rank], self.chunk[rows][row, rank] = new_score[order], new_chunk[order]

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        there = np.isfinite(self.score)
        owner = pa.array(np.repeat(np.arange(len(self.ids)), there.sum(axis=1)))
        return pa.RecordBatch.from_arrays([self.ids.take(owner), pa.array(self.chunk[there], kind), pa.array(self.score[there])], names=["query_id", "chunk_id", "similarity"])


def best_kinds(asked: DataFrame, usable: DataFrame) -> tuple[str, pa.DataType, type]:
    """The schema of `Best.rows`, and the chunk ids' types in Arrow and numpy."""
    chunk = usable.schema["chunk_id"].dataType
    kind = to_arrow_type(chunk)
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {chunk.simpleString()}, similarity double", kind, np.int64 if pa.types.is_integer(kind) else object


def _sent_topk(asked: DataFrame, usable: DataFrame, k: int) -> DataFrame:
    held, (schema, arrow, kind) = asked.toArrow(), best_kinds(asked, usable)
    ids = held.column("query_id").combine_chunks()
    sent = usable.sparkSession.sparkContext.broadcast((ids, unit_vectors(held.column("embedding").combine_chunks()) if held.num_rows else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k, kind)
        for batch in batches:
            if batch.num_rows and len(best.ids):
                best.meet(ids_of(batch.column("chunk_id")), unit_vectors(batch.column("embedding")))
        yield best.rows(arrow)

    return usable.mapInArrow(run, schema)


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term")).filter(~F.col("term").isin(*STOP_WORDS))
    return (stem_terms(terms) if stem else terms).distinct()


def term_table(said: DataFrame, stem: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """(word, term) of the different words of said (word) that count, each once; of `asked` (term), only those terms. Written once."""
    if stem:
        table = said.select("word").filter(~F.col("word").isin(*STOP_WORDS)).distinct().withColumn("term", stemmed("word"))
        table = table if asked is None else table.join(asked.select("term").distinct(), "term", "left_semi")
    else:
        table = asked.select("term", F.col("term").alias("word")).distinct()
    return cut(table)


def word_terms(said: DataFrame, stem: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """`term_table`, marked to be sent to all tasks if it has at most SENT_TERMS rows."""
    table = term_table(said, stem, asked)
    return F.broadcast(table) if table.limit(SENT_TERMS + 1).count() <= SENT_TERMS else table


def postings(chunks: DataFrame, stem: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, tf) without stop words; terms are stemmed unless told otherwise. Of `asked` (term), only those terms.

    Words become terms by `word_terms`, a table of the different words that count, which meets the words of chunks before anything of these is shuffled.
    """
    said = chunks.select("chunk_id", F.explode(words(F.col("content"))).alias("word"))
    if asked is None and not stem:
        return said.filter(~F.col("word").isin(*STOP_WORDS)).groupBy("chunk_id", F.col("word").alias("term")).agg(F.count("*").alias("tf"))
    return said.join(word_terms(said, stem, asked), "word").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int, stem: bool = True) -> DataFrame:
    """(query_id, chunk_id, keyword_rank, rank): the k chunks with most occurrences among those that hold every term of the query; ties by chunk_id. A query of stop words matches nothing.

    Queries of the same terms are searched for once. Up to SENT_TERMS asked terms are sent to all tasks, which find the queries' chunks where these are, so that only the k best
    of a query and partition are shuffled. More meet the postings of their terms.
    """
    asked = query_terms(queries, stem).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asked = cut(asked.select("query_id", F.array_join("terms", " ").alias("asked"), "terms"))
    lists = cut(asked.select("asked", "terms").distinct())
    terms = lists.select(F.col("asked").alias("query_id"), F.explode("terms").alias("term"))
    met = _sent_keywords(lists, chunks, k, stem) if terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS else None
    met = _joined_keywords(cut(terms), chunks, stem) if met is None else met
    best = ranked(met.withColumnRenamed("query_id", "asked"), k, F.desc("keyword_rank"), F.col("chunk_id"), by="asked")
    return asked.select("query_id", "asked").join(best, "asked").select("query_id", "chunk_id", "keyword_rank", "rank")


def whole_chunks(chunks: DataFrame) -> DataFrame | None:
    """(chunk_id, content) with one row for each chunk: rows of the same id are one content. None if an id is null."""
    again = cut(chunks.groupBy("chunk_id").count().filter("count > 1 or chunk_id is null").select("chunk_id"))
    chunks = chunks.select("chunk_id", "content")
    if again.isEmpty():
        return chunks
    if not again.filter("chunk_id is null").isEmpty():
        return None
    merged = chunks.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.array_join(F.collect_list("content"), "\n").alias("content"))
    return chunks.join(again, "chunk_id", "left_anti").unionByName(merged)


def _joined_keywords(asked: DataFrame, chunks: DataFrame, stem: bool) -> DataFrame:
    """(query_id, chunk_id, keyword_rank) of the chunks that hold all terms of asked (query_id, term). They are those of a query's rarest term: the others only add to these."""
    found = cut(postings(chunks, stem, asked))
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    weighed = asked.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = weighed.groupBy("query_id").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("need"))
    drawn = found.join(rarest, "term").select("query_id", "chunk_id", "need", F.col("tf").alias("first_tf"), F.col("term").alias("rarest"))
    others = asked.join(rarest.select("query_id", F.col("term").alias("rarest")), "query_id").filter("term <> rarest").select("query_id", "term")
    more = drawn.filter("need > 1").join(others, "query_id").join(found, ["chunk_id", "term"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("have"), F.sum("tf").alias("tf"))
    met = drawn.join(more, ["query_id", "chunk_id"], "left").filter(F.col("need") == F.coalesce("have", F.lit(0)) + 1)
    return met.select("query_id", "chunk_id", (F.col("first_tf") + F.coalesce("tf", F.lit(0))).alias("keyword_rank"))


@dataclass(frozen=True)
class AskedTerms:
    """The different term lists of queries. Terms are numbered, and so are lists; the list `led[led_from[t] : led_from[t + 1]]` are led by term t, the one that fewest lists have, and
    `rest[rest_from[i] : rest_from[i + 1]]` are the other terms of list i. `term_of` has the term of each of `words`."""

    words: pa.Array
    term_of: np.ndarray
    led_from: np.ndarray
    led: np.ndarray
    rest_from: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(lists: list[list[str]], spoken: pa.Table) -> AskedTerms:
        names = {t: i for i, t in enumerate(sorted({t for terms in lists for t in terms}))}
        asked = Counter(t for terms in lists for t in terms)
        leads = [min(terms, key=lambda t: (asked[t], t)) for terms in lists]
        lead, others = np.array([names[t] for t in leads], np.int64), [[names[t] for t in terms if t != first] for terms, first in zip(lists, leads, strict=True)]
        starts = lambda sizes: np.append(0, np.cumsum(sizes)).astype(np.int64)
        term_of = np.array([names[t] for t in spoken.column("term").to_pylist()], np.int64)
        rest = np.array([t for terms in others for t in terms], np.int64)
        return AskedTerms(spoken.column("word").combine_chunks(), term_of, starts(np.bincount(lead, minlength=len(names))), np.argsort(lead, kind="stable"), starts([len(t) for t in others]), rest)

    def occurrences(self, said: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of lists of words: (row * terms + term) in order, and how often the row says the term."""
        row = np.repeat(np.arange(len(said)), pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(said.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.unique(row[at >= 0] * (len(self.led_from) - 1) + self.term_of[at[at >= 0]], return_counts=True)

    def met(self, said: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(list, row, occurrences) of the term lists that a row holds all terms of, in parts of about MET matches."""
        key, times = self.occurrences(said)
        n_terms = len(self.led_from) - 1
        row, term = np.divmod(key, n_terms)
        n = self.led_from[term + 1] - self.led_from[term]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MET, "right")))
            part = slice(lo, hi)
            at = np.repeat(np.arange(lo, hi), n[part])
            within = np.arange(len(at)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            which, total = self.led[self.led_from[term[at]] + within], times[at]
            more, lo = self.rest_from[which + 1] - self.rest_from[which], hi
            for i in range(int(more.max(initial=0))):
                asking = np.flatnonzero(more > i)
                want = row[at[asking]] * n_terms + self.rest[self.rest_from[which[asking]] + i]
                place = np.minimum(np.searchsorted(key, want), len(key) - 1)
                total[asking] += times[place]
                kept = np.ones(len(at), bool)
                kept[asking] = key[place] == want
                at, which, total, more = at[kept], which[kept], total[kept], more[kept]
            yield which, row[at], total


#: Rows of chunks whose words are counted at once, and matches that are held before all but the k best of each list go.
ROWS, MET = 512, 1 << 20


def _sent_keywords(lists: DataFrame, chunks: DataFrame, k: int, stem: bool) -> DataFrame | None:
    """(query_id, chunk_id, keyword_rank) of lists (asked, terms), which are the query ids here: the k best chunks of each list and partition. None if more than SENT_TERMS different words have the terms' stems, or a chunk has no id."""
    chunks = whole_chunks(chunks)
    if chunks is None:
        return None
    said = chunks.select("chunk_id", words(F.col("content")).alias("words"))
    spoken = term_table(said.select(F.explode("words").alias("word")), stem, lists.select(F.explode("terms").alias("term")))
    if stem and spoken.limit(SENT_TERMS + 1).count() > SENT_TERMS:
        return None
    held, (_, arrow, kind) = lists.toArrow(), best_kinds(lists.withColumnRenamed("asked", "query_id"), chunks)
    sent = chunks.sparkSession.sparkContext.broadcast((held.column("asked").combine_chunks(), AskedTerms.of(held.column("terms").to_pylist(), spoken.toArrow())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        none, some = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)), []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            which, chunk, total = (np.concatenate(c) for c in zip(none, *some, strict=True))
            order = np.lexsort((chunk if chunk.dtype != object else np.unique(chunk, return_inverse=True)[1], -total, which))
            which = which[order]
            kept = np.arange(len(which)) - np.searchsorted(which, which) < k
            return which[kept], chunk[order][kept], total[order][kept]

        size = limit = 0
        for batch in batches:
            ids = ids_of(batch.column("chunk_id"))
            for lo in range(0, batch.num_rows if len(names) else 0, ROWS):
                for which, row, total in asked.met(batch.column("words").slice(lo, ROWS)):
                    some.append((which, ids[lo + row], total))
                    size += len(which)
                    if size > MET + limit:
                        some = [best()]
                        size = limit = len(some[0][0])
        which, chunk, total = best()
        for lo in range(0, len(which), MET):
            part = slice(lo, lo + MET)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which[part])), pa.array(chunk[part], arrow), pa.array(total[part])], names=["query_id", "chunk_id", "keyword_rank"])

    return said.mapInArrow(run, f"query_id string, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, keyword_rank long")


def drop_source(leg: DataFrame, part: str | None, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A leg of 2k rows a query without the rows whose source_url holds `part` (null stays), ranked anew and cut to k. `by` may name the leg too."""
    kept = leg if part is None else leg.filter(~F.coalesce(F.contains("source_url", F.lit(part)), F.lit(False)))
    return kept.withColumnRenamed("rank", "__old").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("__old"))).filter(F.col("rank") <= k).drop("__old")


def both_legs(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(leg, query_id, chunk_id, rank) of the two legs."""
    named = lambda leg, name: leg.select(F.lit(name).alias("leg"), "query_id", "chunk_id", "rank")
    return named(vector, "vector").unionByName(named(keyword, "keyword"))


def fuse_legs(legs: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of legs (leg, query_id, chunk_id, rank): (query_id, chunk_id, vec_rank, kw_rank, sources, rrf, fused_rank), ties in the vector leg's order, then the keyword leg's."""
    of = lambda name: F.min(F.when(F.col("leg") == name, F.col("rank")))
    both = legs.groupBy("query_id", "chunk_id").agg(of("vector").alias("vec_rank"), of("keyword").alias("kw_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    scored = both.withColumns({"rrf": part("vec_rank") + part("kw_rank"), "sources": F.array_compact(F.array(F.when(F.col("vec_rank").isNotNull(), "vector"), F.when(F.col("kw_rank").isNotNull(), "keyword")))})
    return ranked(scored, k, F.desc("rrf"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank"), F.col("chunk_id"), rank="fused_rank")


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    return fuse_legs(both_legs(vector, keyword), k)


def configurations(legs: DataFrame, queries: DataFrame, bodies: DataFrame, k: int, part: str, margin: float = 1.0) -> DataFrame:
    """(config, query_id, chunk_id, rank, score) of the five rankings that are compared: vector, hybrid, rerank, code_margin and exclusion. Only the last three have a reranker's score.

    `legs` (leg, query_id, chunk_id, rank) has the 2k best of both legs; the first four take the k best, and the last one drops sources with `part` from all of them first.
    `queries` has (query_id, query), `bodies` (chunk_id, content, source_url). Every pair is scored once, whichever rankings it is in, and every content taken apart once.
    """
    placed = cut(legs.join(bodies.select("chunk_id", "source_url"), "chunk_id", "left"))
    short = placed.filter(F.col("rank") <= k)
    mixed = fuse_legs(short, k).withColumn("mix", F.lit("hybrid")).unionByName(fuse_legs(drop_source(placed, part, k, ("query_id", "leg")), k).withColumn("mix", F.lit("exclusion")))
    pairs = cut(mixed.select("mix", "query_id", "chunk_id", "fused_rank"))
    scored = overlap_scores(pairs, queries, bodies)
    met = cut(pairs.join(scored, ["query_id", "chunk_id"]))
    none = F.lit(None).cast("double").alias("score")
    vector = short.filter("leg = 'vector'").select(F.lit("vector").alias("config"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), none)

    def order(config: str, mix: str, *by: Column) -> DataFrame:
        return ranked(met.filter(F.col("mix") == mix), k, *by, F.col("fused_rank")).select(F.lit(config).alias("config"), "query_id", "chunk_id", "rank", "score")

    best = F.desc("score")
    hybrid = pairs.filter("mix = 'hybrid'").select(F.lit("hybrid").alias("config"), "query_id", "chunk_id", F.col("fused_rank").cast("int").alias("rank"), none)
    rest = (hybrid, order("rerank", "hybrid", best), order("code_margin", "hybrid", F.desc(F.col("score") + F.when(F.col("code"), margin).otherwise(0.0))), order("exclusion", "exclusion", best))
    for one in rest:
        vector = vector.unionByName(one)
    return vector


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's words that the content has; the stand-in for a trained reranker."""
    asked = F.array_distinct(words(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(content))) / F.size(asked)).otherwise(0.0)


def overlap_scores(pairs: DataFrame, queries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, code) of the different pairs (query_id, chunk_id): their `overlap_score`, and whether the content has a code fence.

    A content is taken apart once for all of its queries, which ask for the words that any of them has; pairs then meet the few that it holds, and no text.
    Asked words go to the contents where they are if there are at most SENT_TERMS.
    """
    wants = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("asked"))
    asked = cut(pairs.select("query_id", "chunk_id").distinct().join(wants, "query_id"))
    wanted = cut(asked.select("chunk_id", "asked").distinct().groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("wanted")))
    few = (wanted.agg(F.sum(F.size("wanted") + 1)).first()[0] or 0) <= SENT_TERMS
    met = bodies.select("chunk_id", "content").join(F.broadcast(wanted) if few else wanted, "chunk_id")
    held = cut(met.select("chunk_id", F.array_intersect("wanted", words(F.col("content"))).alias("held"), F.contains("content", F.lit("```")).alias("code")))
    score = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "held")) / F.size("asked")).otherwise(0.0)
    return asked.join(held, "chunk_id").select("query_id", "chunk_id", score.cast("double").alias("score"), "code")


def rerank(candidates: DataFrame, top_n: int, scorer: Callable[[Column, Column], Column] = overlap_score, code_margin: float = 0.0) -> DataFrame:
    """Candidates (query_id, query, content, fused_rank, ...) with rerank_score and rank, the top_n best; `code_margin` favours chunks with a code fence in the order but not in the score."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("content")).cast("double"))
    key = F.coalesce("rerank_score", F.lit(0.0)) + F.when(F.contains("content", F.lit("```")), code_margin).otherwise(0.0)
    return ranked(scored.withColumn("__key", key), top_n, F.desc("__key"), F.col("fused_rank")).drop("__key")


def refusals(queries: DataFrame, candidates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(query_id, n_candidates, top_score, refused): no candidate, or the best score below the threshold; candidates without any score are not refused."""
    seen = candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rerank_score").alias("top_score"))
    out = queries.select("query_id").join(seen, "query_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("query_id", n.alias("n_candidates"), "top_score", ((n == 0) | F.coalesce(F.col("top_score") < threshold, F.lit(False))).alias("refused"))


STRUCTURED_SCORE = 15.0


def routed(structured: DataFrame, prose: DataFrame, k: int) -> DataFrame:
    """Structured passages (query_id, ord, content) above prose rows (query_id, chunk_id, content, rerank_score, rank), at most k of all a query."""
    kind = prose.schema["chunk_id"].dataType
    top = structured.select("query_id", (-1 - F.col("ord")).cast(kind).alias("chunk_id"), "content", F.lit(STRUCTURED_SCORE).alias("rerank_score"), F.lit(0).alias("__leg"), F.col("ord").cast("long").alias("__ord"))
    rest = prose.select("query_id", "chunk_id", "content", F.col("rerank_score").cast("double").alias("rerank_score"), F.lit(1).alias("__leg"), F.col("rank").cast("long").alias("__ord"))
    return ranked(top.unionByName(rest), k, F.col("__leg"), F.col("__ord")).drop("__leg", "__ord")


#: Characters of a passage that a judge of answers sees: more than any passage that generation has seen.
JUDGE_CHARS = 4_000


def context_blocks(results: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(query_id, context): numbered passages in rank order, a blank line between; contents are clipped to `most_chars` code points if that is given, as a judge's are to JUDGE_CHARS."""
    content = F.coalesce("content", F.lit(""))
    content = F.col("content") if most_chars is None else F.substring(content, 1, most_chars)
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.when(F.coalesce("heading_path", F.lit("")) == "", "(untitled)").otherwise(F.col("heading_path")), F.lit("\n"), content)
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


#: Fixed pattern of citation groups in both bracket styles.
CITATION = r"[\[【](\d+(?:\s*[,-]\s*\d+)*)[\]】]"


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, position, idx, source_url): the sources (query_id, idx, source_url) that an answer (query_id, answer) cites, each once, in order of first appearance."""
    groups = F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1))
    numbers = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)))))
    cited = answers.select("query_id", F.posexplode(numbers).alias("at", "number")).select("query_id", "at", F.col("number").try_cast("int").alias("idx"))
    met = cited.join(sources.select("query_id", "idx", "source_url"), ["query_id", "idx"])
    return met.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "position", "idx", "source_url")
