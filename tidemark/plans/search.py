"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import STOP_WORDS
from tidemark.operators import index, ingest, pivots
from tidemark.operators import search as op
from tidemark.operators.lineage import cut, fresh_folder
from tidemark.plans.tables import CHUNKS_SQL, QUESTIONS_SQL, WORDS_SQL, asked_vectors, chunks, longs, questions, table, vectors

K, EXCLUDED = 20, "/src1/"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def vector_sql(k: int) -> str:
    return f"""vec AS (SELECT query_id, chunk_id, similarity, rank FROM (SELECT q.query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity,
 row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank FROM questions q, embeddings c) WHERE rank <= {k})"""


def keyword_sql(k: int) -> str:
    return f"""tokens AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '{WORDS_SQL}')) AS term FROM chunks),
 posts AS (SELECT chunk_id, term, count(*) AS tf FROM tokens WHERE term NOT IN ({_STOPS}) GROUP BY ALL),
 asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{WORDS_SQL}')) AS term FROM questions) WHERE term NOT IN ({_STOPS})),
 need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY 1),
 met AS (SELECT a.query_id, p.chunk_id, count(*) AS have, sum(tf)::BIGINT AS keyword_rank FROM asked a JOIN posts p USING (term) GROUP BY ALL),
 kw AS (SELECT query_id, chunk_id, keyword_rank, rank FROM (SELECT query_id, chunk_id, keyword_rank, row_number() OVER (PARTITION BY query_id ORDER BY keyword_rank DESC, chunk_id) AS rank FROM met JOIN need USING (query_id) WHERE have = need) WHERE rank <= {k})"""


def drop_sql(out: str, leg: str) -> str:
    return f"{out} AS (SELECT query_id, chunk_id, rank FROM (SELECT l.query_id, l.chunk_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank FROM {leg} l LEFT JOIN chunks c USING (chunk_id) WHERE NOT coalesce(contains(c.source_url, '{EXCLUDED}'), false)) WHERE rank <= {K})"


def fused_sql(v: str, w: str, out: str = "fused") -> str:
    return f"""{out}_legs AS (SELECT query_id, chunk_id, rank AS vec_rank, NULL::BIGINT AS kw_rank FROM {v} UNION ALL SELECT query_id, chunk_id, NULL, rank FROM {w}),
 {out}_both AS (SELECT query_id, chunk_id, min(vec_rank) AS vec_rank, min(kw_rank) AS kw_rank FROM {out}_legs GROUP BY ALL),
 {out}_scored AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vec_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + kw_rank), 0.0) AS rrf FROM {out}_both),
 {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_rank NULLS LAST, kw_rank NULLS LAST, chunk_id) AS fused_rank FROM {out}_scored) WHERE fused_rank <= {K})"""


def scored_sql(fused: str, out: str = "rr") -> str:
    return f"""{out}_pairs AS (SELECT f.query_id, f.chunk_id, f.fused_rank, q.query, c.content, c.heading_path, c.source_url FROM {fused} f JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id)),
 {out}_words AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '{WORDS_SQL}')) AS aw, list_distinct(regexp_extract_all(lower(content), '{WORDS_SQL}')) AS cw FROM {out}_pairs),
 {out} AS (SELECT *, CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw))::DOUBLE / len(aw) ELSE 0.0 END AS rerank_score FROM {out}_words)"""


_BASE = f"WITH {QUESTIONS_SQL}, {CHUNKS_SQL}"
_HYBRID = f"{_BASE}, {vector_sql(2 * K)}, {keyword_sql(2 * K)}, {drop_sql('v2', 'vec')}, {drop_sql('w2', 'kw')}, {fused_sql('v2', 'w2')}"
_RERANKED = f"{_HYBRID}, {scored_sql('fused')}, top AS (SELECT query_id, chunk_id, fused_rank, content, heading_path, source_url, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM rr) WHERE rank <= 5)"


def asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, taken from the documents once for all their uses in a query."""
    return cut(questions(spark, sf_dir))


def legs(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    return op.vector_topk(asked, vectors(spark, sf_dir), k), op.keyword_topk(asked, chunks(spark, sf_dir), k, stem=False)


def _fused(spark: SparkSession, sf_dir: str, asked: DataFrame, part: str | None = EXCLUDED) -> DataFrame:
    urls = chunks(spark, sf_dir).select("chunk_id", "source_url")
    both = op.both_legs(*legs(spark, sf_dir, asked, 2 * K)).join(urls, "chunk_id", "left")
    return op.fuse_legs(op.drop_source(both, part, K, ("query_id", "leg")), K)


def _pairs(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    body = chunks(spark, sf_dir).select("chunk_id", "content", "heading_path", "source_url")
    return _fused(spark, sf_dir, asked).select("query_id", "chunk_id", "fused_rank").join(asked.select("query_id", "query"), "query_id").join(body, "chunk_id")


def _best(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    return op.rerank(_pairs(spark, sf_dir, asked_once(spark, sf_dir) if asked is None else asked), 5)


def in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus in one version, and another in all of its versions."""
    every = chunks(spark, sf_dir)
    both = op.in_scope(every, "src1", "en").withColumn("scope", F.lit("one")).unionByName(op.in_scope(every, "src2").withColumn("scope", F.lit("all")))
    return both.select("scope", "chunk_id", "corpus", "doc_version")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.vector_topk(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), K)
    return longs(out.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank"))


def vector_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vector_topk` with the tiles left out that can't hold an answer."""
    out = pivots.pruned_topk(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), K).rows
    return longs(out.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank"))


def vector_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over chunks as ingestion stamps them: ids are digests."""
    stored = vectors(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("doc_key"), F.lit(0).alias("chunk_no"), "embedding")
    asked = asked_vectors(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    out = op.vector_topk(asked, ingest.stamp(stored, "docs", "2.0"), K)
    return longs(out.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank"))


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.keyword_topk(questions(spark, sf_dir), chunks(spark, sf_dir), K, stem=False))


def keyword_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed search; SQL has no stemmer, so a test counts stems plainly."""
    return longs(op.keyword_topk(questions(spark, sf_dir), chunks(spark, sf_dir), K))


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an index of all chunks, in which the slices of one corpus are then replaced."""
    folder, every = fresh_folder(spark, "index"), chunks(spark, sf_dir)
    index.index_slices(every.withColumn("content", F.when(F.col("corpus") == "src1", "not yet").otherwise(F.col("content"))), folder, stem=False)
    index.index_slices(every.filter("corpus = 'src1'"), folder, stem=False)
    return folder


def keyword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`keyword_topk` over the kept index."""
    found = index.search(questions(spark, sf_dir), _indexed(spark, sf_dir), K, index.occurrences, stem=False)
    return longs(found.rows.select("query_id", "chunk_id", F.col("score").cast("long").alias("keyword_rank"), "rank"))


def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.search(questions(spark, sf_dir), _indexed(spark, sf_dir), K, index.bm25, stem=False)
    return longs(found.rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.fuse(*legs(spark, sf_dir, asked_once(spark, sf_dir), K), K).select("query_id", "chunk_id", "vec_rank", "kw_rank", F.round("rrf", 9).alias("rrf"), "fused_rank"))


def hybrid_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_fused(spark, sf_dir, asked_once(spark, sf_dir)).select("query_id", "chunk_id", "vec_rank", "kw_rank", F.round("rrf", 9).alias("rrf"), "fused_rank"))


def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_best(spark, sf_dir).select("query_id", "chunk_id", "fused_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank"))


def fenced(bodies: DataFrame) -> DataFrame:
    """Documents have no code fences, so a fence is put behind those with a table bar."""
    return bodies.withColumn("content", F.when(F.contains("content", F.lit("|")), F.concat("content", F.lit("\n```"))).otherwise(F.col("content")))


def code_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fenced(_pairs(spark, sf_dir, asked_once(spark, sf_dir)))
    return longs(op.rerank(pairs, 5, code_margin=1.0).select("query_id", "chunk_id", "fused_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank"))


def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole default pipeline: both legs, exclusion, fusion, reranking, the five best with their source and refusal flag."""
    asked = asked_once(spark, sf_dir)
    best = cut(_best(spark, sf_dir, asked).select("query_id", "chunk_id", "rank", "rerank_score", "source_url"))
    gate = op.refusals(asked, best, 0.5).select("query_id", "refused")
    return longs(best.withColumn("rerank_score", F.round("rerank_score", 6)).join(gate, "query_id"))


def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_once(spark, sf_dir)
    gate = op.refusals(asked, _best(spark, sf_dir, asked), 0.5)
    return longs(gate.select("query_id", "n_candidates", F.round("top_score", 6).alias("top_score"), "refused"))


def routed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose key is the query's id stand in for structured passages."""
    asked = asked_once(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit(0).alias("ord"), F.col("p_name").alias("content"))
    out = op.routed(parts.join(asked.select("query_id"), "query_id", "left_semi"), _best(spark, sf_dir, asked), 5)
    return longs(out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank"))


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.context_blocks(_best(spark, sf_dir))


def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.context_blocks(_best(spark, sf_dir), op.JUDGE_CHARS)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with markers behind them cite the user turns of their conversation in order."""
    turns = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    marks = F.concat_ws(" ", F.lit(""), F.concat(F.lit("["), (F.col("turn") % 4 + 1).cast("string"), F.lit("]")), F.lit("[1, 2] 【3】 [9-2] [x]"))
    answers = turns.filter("role = 'assistant'").select(key.alias("query_id"), "conv_id", F.concat(F.coalesce("text", F.lit("")), marks).alias("answer"))
    users = turns.filter("role = 'user'").select("conv_id", F.expr("cast(row_number() over (partition by conv_id order by turn) as int)").alias("idx"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("source_url"))
    sources = answers.select("query_id", "conv_id").join(users, "conv_id")
    return longs(op.citations(answers, sources))


SQL = {
    "in_scope": f"WITH {CHUNKS_SQL} SELECT 'one' AS scope, chunk_id, corpus, doc_version FROM chunks WHERE corpus = 'src1' AND doc_version = 'en' UNION ALL SELECT 'all', chunk_id, corpus, doc_version FROM chunks WHERE corpus = 'src2'",
    "vector_topk": f"{_BASE}, {vector_sql(K)} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM vec",
    "vector_pruned": f"{_BASE}, {vector_sql(K)} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM vec",
    "vector_stamped": f"""WITH {QUESTIONS_SQL}, e AS (SELECT embedding, sha256(concat_ws(chr(1), 'docs', '2.0', vec_id::VARCHAR, '0')) AS chunk_id FROM embeddings),
 s AS (SELECT 'q' || q.query_id AS query_id, e.chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM questions q, e)
 SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) WHERE rank <= {K}""",
    "keyword_topk": f"{_BASE}, {keyword_sql(K)} SELECT * FROM kw",
    "keyword_indexed": f"{_BASE}, {keyword_sql(K)} SELECT * FROM kw",
    "keyword_bm25": f"""{_BASE}, {keyword_sql(K)}, sizes AS (SELECT chunk_id, coalesce(sum(tf), 0)::BIGINT AS length FROM chunks LEFT JOIN posts USING (chunk_id) GROUP BY 1), whole AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean FROM sizes),
 df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1), part AS (SELECT a.query_id, p.chunk_id, ln(1.0::DOUBLE + (whole.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + length * 0.75::DOUBLE / mean)) AS s
  FROM asked a JOIN posts p USING (term) JOIN df USING (term) JOIN sizes USING (chunk_id), whole),
 scored AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM part JOIN need USING (query_id) GROUP BY query_id, chunk_id, need HAVING count(*) = need)
 SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {K}""",
    "rrf_fuse": f"{_BASE}, {vector_sql(K)}, {keyword_sql(K)}, {fused_sql('vec', 'kw')} SELECT query_id, chunk_id, vec_rank, kw_rank, round(rrf, 9) AS rrf, fused_rank FROM fused",
    "hybrid_exclude": f"{_HYBRID} SELECT query_id, chunk_id, vec_rank, kw_rank, round(rrf, 9) AS rrf, fused_rank FROM fused",
    "rerank_topn": f"{_RERANKED} SELECT query_id, chunk_id, fused_rank, round(rerank_score, 6) AS rerank_score, rank FROM top",
    "code_margin": f"{_RERANKED} SELECT query_id, chunk_id, fused_rank, round(rerank_score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score + CASE WHEN contains(content, '|') THEN 1.0 ELSE 0.0 END DESC, fused_rank) AS rank FROM rr) WHERE rank <= 5",
    "refusal_gate": f"{_RERANKED} SELECT q.query_id, count(t.chunk_id) AS n_candidates, round(max(t.rerank_score), 6) AS top_score, count(t.chunk_id) = 0 OR coalesce(max(t.rerank_score) < 0.5, false) AS refused FROM questions q LEFT JOIN top t USING (query_id) GROUP BY 1",
    "hybrid_answers": f"{_RERANKED}, gate AS (SELECT query_id, max(rerank_score) < 0.5 AS refused FROM top GROUP BY 1) SELECT query_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score, source_url, refused FROM top JOIN gate USING (query_id)",
    "routed_union": f"{_RERANKED}, mixed AS (SELECT p_partkey AS query_id, -1::BIGINT AS chunk_id, 15.0::DOUBLE AS rerank_score, 0 AS leg, 0 AS o FROM part JOIN questions ON p_partkey = query_id UNION ALL SELECT query_id, chunk_id, rerank_score, 1, rank FROM top) SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leg, o) AS rank FROM mixed) WHERE rank <= 5",
    "context_block": f"{_RERANKED} SELECT query_id, string_agg('[' || rank || '] ' || CASE WHEN coalesce(heading_path, '') = '' THEN '(untitled)' ELSE heading_path END || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY 1",
    "judge_context": f"{_RERANKED} SELECT query_id, string_agg('[' || rank || '] ' || CASE WHEN coalesce(heading_path, '') = '' THEN '(untitled)' ELSE heading_path END || chr(10) || left(coalesce(content, ''), 4000), chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY 1",
    "citations": """WITH answers AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, coalesce(text, '') || ' [' || (turn % 4 + 1) || '] [1, 2] 【3】 [9-2] [x]' AS answer FROM conversations WHERE role = 'assistant'),
 users AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, 'turn-' || turn AS source_url FROM conversations WHERE role = 'user'),
 nums AS (SELECT query_id, conv_id, list_distinct(n) AS d, n FROM (SELECT query_id, conv_id, flatten(list_transform(regexp_extract_all(answer, '[\\[【](\\d+(?:\\s*[,-]\\s*\\d+)*)[\\]】]', 1), lambda g: regexp_extract_all(g, '\\d+'))) AS n FROM answers)),
 flat AS (SELECT query_id, conv_id, unnest(d)::BIGINT AS idx, unnest(list_transform(d, lambda x: list_position(n, x))) AS place FROM nums)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, idx, source_url FROM flat JOIN users USING (conv_id, idx)""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "keyword_stemmed")}
