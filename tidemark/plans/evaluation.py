"""Registered evaluation queries. A question is a vector whose id is divisible by 20 with words of its document, and documents whose vectors have its label are right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.operators import search as op
from tidemark.operators.lineage import cut, fresh_folder
from tidemark.plans import questions as asked
from tidemark.plans import search
from tidemark.plans.search import K, drop_sql, fused_sql, keyword_sql, scored_sql, vector_sql
from tidemark.plans.tables import CHUNKS_SQL, QUESTIONS_SQL, chunks, longs, questions, table, vectors
from tidemark.sources import lines

CONFIGS = ["vector", "hybrid", "rerank", "code_margin", "exclusion"]


def _rankings(spark, sf_dir, q: DataFrame) -> DataFrame:
    """The five rankings of questions, each row with whether it is right: its label is the question's, which no join of all pairs of a label has to tell."""
    legs = op.both_legs(*search.legs(spark, sf_dir, q, 2 * K))
    ranked = op.configurations(legs, q, search.fenced(chunks(spark, sf_dir)), K, search.EXCLUDED)
    labels = vectors(spark, sf_dir).select("chunk_id", "label")
    met = ranked.join(labels, "chunk_id", "left").join(q.select("query_id", F.col("label").alias("want")), "query_id")
    right = F.coalesce(F.col("label") == F.col("want"), F.lit(False)) & (F.col("chunk_id") != F.col("query_id"))
    return met.select("config", F.col("query_id").alias("qid"), "chunk_id", "rank", "score", right.alias("right"))


def _scores(spark, sf_dir) -> DataFrame:
    q = search.asked_once(spark, sf_dir)
    return evaluate.score_rankings(_rankings(spark, sf_dir, q), q.select(F.col("query_id").alias("qid")), CONFIGS)


def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_scores(spark, sf_dir).withColumn("rr", F.round("rr", 6)))


def eval_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluate.config_means(_scores(spark, sf_dir))
    return means.select("config", "n", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_8", "mrr")))


def eval_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cut(evaluate.config_means(_scores(spark, sf_dir)))
    order = means.select("config", (F.array_position(F.array(*map(F.lit, CONFIGS)), F.col("config")) - 1).alias("ord"))
    return evaluate.best_config(means, order).select("config", F.round("hit_5", 6).alias("hit_5"), F.round("mrr", 6).alias("mrr"))


def eval_worst5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(evaluate.worst(_scores(spark, sf_dir)).select("config", "qid", "first_rank", F.round("rr", 6).alias("rr"), "place"))


def eval_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other question, with a word that no text has, through the rankings and the gate of the three reranked configurations."""
    q = cut(questions(spark, sf_dir).filter("query_id % 40 = 0").withColumn("query", F.concat("query", F.lit(" zzqx"))))
    gates = evaluate.off_corpus_gates(_rankings(spark, sf_dir, q), q.select(F.col("query_id").alias("qid")), CONFIGS[2:], 0.5)
    return evaluate.refusal_accuracy(gates)


def rank1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong first rows of the five configurations by the family of their url, of at least five rows."""
    first = _rankings(spark, sf_dir, search.asked_once(spark, sf_dir)).filter("rank = 1 and not right")
    return evaluate.failure_families(first.join(chunks(spark, sf_dir).select("chunk_id", "source_url"), "chunk_id", "left"), 5)


def by_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxicity is the type, quality the hit."""
    scores = table(spark, sf_dir, "labels").select(F.concat(F.lit("toxic-"), F.col("toxic").cast("string")).alias("type"), F.col("quality").alias("hit_1"), (F.col("quality") / F.lit(2.0)).alias("rr"))
    return evaluate.by_type(scores).select("type", "n", F.round("hit_1", 6).alias("hit_1"), F.round("mrr", 6).alias("mrr"))


def _judged(spark, sf_dir) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, "no score").otherwise(F.concat(F.lit("Score: "), (F.col("quality") * 2 + F.col("toxic") + 1).cast("string"), F.lit("/5")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), text.alias("judge_text"))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(evaluate.score_distribution(_judged(spark, sf_dir)).withColumn("share", F.round("share", 6)))


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.faithfulness(_judged(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


def least_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(evaluate.least_faithful(_judged(spark, sf_dir)))


def numeric_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads as answers to 'what is the value, to the nearest whole number'."""
    answers = table(spark, sf_dir, "events").select(F.col("props").alias("answer"), F.concat("props", F.lit(" "), F.round("value", 2).cast("string")).alias("context"), F.col("value"), F.lit(0.5).alias("tolerance"), (F.col("event_id") % 10 == 0).alias("refused"))
    out = evaluate.numeric_report(answers)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("answer_accuracy", "context_accuracy", "gap")))


def set_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and toxic words as names that a document should hold."""
    names = [*"the and pathetic clown idiot die der le la les el".split(), "missing name"]
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text", F.array(*map(F.lit, names)).alias("items"), F.lit(0.3).alias("min_recall"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("name"))
    out = evaluate.set_recall(answers, words)
    return out.withColumn("recall", F.round("recall", 6))


def paired_discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired(_scores(spark, sf_dir), "vector", "rerank").withColumn("p_value", F.round("p_value", 9))


def hit_by_tercile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = questions(spark, sf_dir).select(F.col("query_id").alias("qid")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("n_chars").cast("double").alias("mean_length")), "qid")
    return longs(evaluate.hit_by_tercile(_scores(spark, sf_dir), lengths).withColumn("hit_1", F.round("hit_1", 6)))


def label_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and tags of parts against a copy in which some moved, some went, and all lists are reversed."""
    part = table(spark, sf_dir, "part")
    items = F.array("p_type", "p_brand")
    old = part.select(F.col("p_partkey").alias("qid"), F.col("p_retailprice").alias("value"), items.alias("items"))
    moved = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    new = part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("qid"), moved.alias("value"), F.when(F.col("p_partkey") % 11 == 0, F.array("p_type")).otherwise(F.reverse(items)).alias("items"))
    return evaluate.label_diff(old, new)


def label_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file with comments, blanks and labels of three types, written, refreshed, written again and read back."""
    k, text, folder = F.col("p_partkey"), F.col("p_partkey").cast("string"), fresh_folder(spark, "labels")
    part, said = table(spark, sf_dir, "part"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line = F.when(k % 5 == 0, said("# part ", text)).when(k % 5 == 1, said('{"question": "value of ', text, '", "type": "numeric", "answer": {"item": "é"}, "value": ', F.col("p_size").cast("string"), "}"))
    line = line.when(k % 5 == 2, said('{"question": "items of ', text, '", "type": "multi_row", "items": ["', F.col("p_brand"), '", "a"]}')).when(k % 5 == 3, "").otherwise(said('{"question":"why ', text, '",  "type": "prose", "value": 0}\r'))
    lines.write_lines(part.select(k.alias("at"), line.alias("line")), f"{folder}/old")
    values = part.filter(k % 7 != 0).select(
        F.when(k % 5 == 1, said("value of ", text)).when(k % 5 == 2, said("items of ", text)).otherwise(said("why ", text)).alias("qid"),
        F.when(k % 5 != 2, F.col("p_size") + F.when(k % 3 == 0, 1).otherwise(0)).cast("double").alias("value"),
        F.when(k % 5 == 2, F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.col("p_brand")))).alias("items"),
    )
    lines.write_lines(evaluate.refresh_lines(lines.read_lines(spark, f"{folder}/old"), values), f"{folder}/new")
    return lines.read_lines(spark, f"{folder}/new")


def dead_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    expected = pages.select(F.col("page_id").alias("qid"), F.lit("web").alias("corpus"), F.array(F.col("url"), F.concat("url", F.lit("x"))).alias("expected_urls"))
    return evaluate.dead_urls(expected, pages.filter("page_id % 3 <> 0").select(F.lit("web").alias("corpus"), F.col("url").alias("source_url")))


def behaviour_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on the parts, each template with the kind that it should classify to."""
    linked = asked._linked(spark, sf_dir).select("query_id", "intent.kind")
    kinds = {4: "matchup", 5: "counters", 6: "build", 7: "champion_stats"}
    want = F.lit(None).cast("string")
    for k, kind in kinds.items():
        want = F.when(F.col("query_id") % 9 == k, kind).otherwise(want)
    return evaluate.behaviour(linked.select("query_id", want.alias("kind")), linked)


_MIXED = f"""WITH {QUESTIONS_SQL}, {CHUNKS_SQL}, {vector_sql(2 * K)}, {keyword_sql(2 * K)}, v1 AS (SELECT * FROM vec WHERE rank <= {K}), w1 AS (SELECT * FROM kw WHERE rank <= {K}), {fused_sql('v1', 'w1', 'hybrid')},
 {drop_sql('v2', 'vec')}, {drop_sql('w2', 'kw')}, {fused_sql('v2', 'w2', 'apart')}, {scored_sql('hybrid', 'hs')}, {scored_sql('apart', 'ps')}"""
_SCORES = f"""{_MIXED}, ranked AS (SELECT 'vector' AS config, query_id AS qid, chunk_id, rank FROM v1 UNION ALL SELECT 'hybrid', query_id, chunk_id, fused_rank FROM hybrid
 UNION ALL SELECT 'rerank', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) FROM hs
 UNION ALL SELECT 'code_margin', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score + CASE WHEN contains(content, '|') THEN 1.0 ELSE 0.0 END DESC, fused_rank) FROM hs
 UNION ALL SELECT 'exclusion', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) FROM ps),
 first AS (SELECT config, qid, min(rank) AS first_rank FROM ranked r JOIN questions q ON q.query_id = r.qid JOIN embeddings e ON e.vec_id = r.chunk_id WHERE e.label = q.label AND r.chunk_id <> r.qid GROUP BY ALL),
 scores AS (SELECT config, qid, first_rank, coalesce((first_rank <= 1)::BIGINT, 0) AS hit_1, coalesce((first_rank <= 3)::BIGINT, 0) AS hit_3, coalesce((first_rank <= 5)::BIGINT, 0) AS hit_5, coalesce((first_rank <= 8)::BIGINT, 0) AS hit_8, coalesce(1.0::DOUBLE / first_rank, 0.0) AS rr
  FROM (SELECT query_id AS qid, unnest({CONFIGS}) AS config FROM questions) LEFT JOIN first USING (config, qid))"""
_MEANS = f"{_SCORES}, means AS (SELECT config, count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5, round(avg(hit_8), 6) AS hit_8, round(avg(rr), 6) AS mrr FROM scores GROUP BY 1)"
SQL = {
    "eval_hits": f"{_SCORES} SELECT * REPLACE (round(rr, 6) AS rr) FROM scores",
    "eval_config": f"{_MEANS} SELECT * FROM means",
    "eval_best": f"{_MEANS} SELECT config, hit_5, mrr FROM means ORDER BY hit_5 DESC, mrr DESC, list_position({CONFIGS}, config) LIMIT 1",
    "eval_worst5": f"{_SCORES} SELECT config, qid, first_rank, round(rr, 6) AS rr, place FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY rr, coalesce(first_rank, 999), qid) AS place FROM scores) WHERE place <= 5",
    "eval_refusal": _MIXED.replace("questions AS (", "q0 AS (", 1).replace(", chunks AS (", ", questions AS (SELECT query_id, embedding, label, query || ' zzqx' AS query FROM q0 WHERE query_id % 40 = 0), chunks AS (", 1)
    + """, ranked AS (SELECT 'rerank' AS config, query_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM hs
 UNION ALL SELECT 'code_margin', query_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score + CASE WHEN contains(content, '|') THEN 1.0 ELSE 0.0 END DESC, fused_rank) FROM hs
 UNION ALL SELECT 'exclusion', query_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) FROM ps),
 top AS (SELECT config, query_id, max(rerank_score) AS top FROM ranked WHERE rank <= 5 GROUP BY ALL)
 SELECT c.config, count(*) FILTER (WHERE top IS NULL OR top < 0.5) AS refused, count(*) AS n FROM (SELECT query_id, unnest(['rerank', 'code_margin', 'exclusion']) AS config FROM questions) c LEFT JOIN top USING (config, query_id) GROUP BY 1""",
    "rank1_failures": f"""{_SCORES}, wrong AS (SELECT r.config, c.source_url FROM ranked r JOIN questions q ON q.query_id = r.qid LEFT JOIN embeddings e ON e.vec_id = r.chunk_id LEFT JOIN chunks c USING (chunk_id) WHERE r.rank = 1 AND NOT (coalesce(e.label = q.label, false) AND r.chunk_id <> r.qid)),
 w AS (SELECT row_number() OVER () AS id, config, '/' || split_part(source_url, '/', 4) || '/' AS near, '/' || split_part(source_url, '/', 4) || '/' || split_part(source_url, '/', 5) AS page FROM wrong),
 s AS (SELECT prefix, count(*) AS support FROM (SELECT near AS prefix FROM w UNION ALL SELECT page FROM w) GROUP BY 1 HAVING count(*) >= 5)
 SELECT config, CASE WHEN page IN (SELECT prefix FROM s) THEN page WHEN near IN (SELECT prefix FROM s) THEN near ELSE 'other' END AS family, count(*) AS n FROM w GROUP BY ALL""",
    "label_apply": """WITH p AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand, p_partkey % 7 <> 0 AS fresh FROM part),
 l AS (SELECT k, CASE k % 5 WHEN 0 THEN '# part ' || k WHEN 1 THEN '{"question": "value of ' || k || '", "type": "numeric", "answer": {"item": "é"}, "value": ' || CASE WHEN fresh AND k % 3 = 0 THEN size + 1 ELSE size END || '}'
  WHEN 2 THEN '{"question": "items of ' || k || '", "type": "multi_row", "items": [' || CASE WHEN fresh AND k % 2 = 0 THEN '"a", "b"' ELSE '"' || brand || '", "a"' END || ']}' WHEN 3 THEN '' ELSE '{"question":"why ' || k || '",  "type": "prose", "value": 0}' || chr(13) END AS line FROM p)
 SELECT coalesce(sum(strlen(line) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, line FROM l""",
    "by_type_report": "SELECT 'toxic-' || toxic AS type, count(*) AS n, round(avg(quality), 6) AS hit_1, round(avg(quality / 2.0::DOUBLE), 6) AS mrr FROM labels GROUP BY 1",
    "score_distribution": "WITH s AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN quality * 2 + toxic + 1 END::BIGINT AS score FROM labels) SELECT score, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1",
    "faithfulness": "WITH s AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN quality * 2 + toxic + 1 END AS score FROM labels) SELECT count(*) AS n, count(score) AS parsed, round(avg(score), 6) AS mean_score FROM s",
    "least_faithful": "SELECT doc_id AS qid, (quality * 2 + toxic + 1)::BIGINT AS score FROM labels WHERE doc_id % 11 <> 0 ORDER BY score, qid LIMIT 5",
    "numeric_presence": """WITH e AS (SELECT event_id, value, props, list_transform(regexp_extract_all(props, '-?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE) AS n FROM events),
 x AS (SELECT (event_id % 10 <> 0 AND len(list_filter(n, lambda y: abs(y - value) <= 0.5 + 1e-9)) > 0)::INT AS a FROM e)
 SELECT count(*) AS n, round(avg(a), 6) AS answer_accuracy, 1.0::DOUBLE AS context_accuracy, round(1.0 - avg(a), 6) AS gap FROM x""",
    "set_recall": """WITH n AS (SELECT unnest(['the', 'and', 'pathetic', 'clown', 'idiot', 'die', 'der', 'le', 'la', 'les', 'el', 'missing name']) AS name), w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS name FROM documents), k AS (SELECT name, name IN (SELECT name FROM w) AS known FROM n)
 SELECT doc_id AS qid, round(count(*) FILTER (WHERE known AND contains(lower(coalesce(text, '')), name))::DOUBLE / 12, 6) AS recall, count(*) FILTER (WHERE known AND contains(lower(coalesce(text, '')), name))::DOUBLE / 12 >= 0.3 AS passed FROM documents, k GROUP BY doc_id, text""",
    "paired_discordant": f"""{_SCORES}, w AS (SELECT qid, max(hit_1) FILTER (WHERE config = 'vector') AS a, max(hit_1) FILTER (WHERE config = 'rerank') AS b FROM scores GROUP BY 1), d AS (SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM w)
 SELECT *, round(least(1.0, 2 * list_sum(list_transform(range(least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 9) AS p_value FROM d""",
    "hit_by_tercile": f"{_SCORES}, t AS (SELECT doc_id AS qid, ntile(3) OVER (ORDER BY n_chars, doc_id) AS tercile FROM documents WHERE doc_id IN (SELECT query_id FROM questions)) SELECT config, tercile, count(*) AS n, round(avg(hit_1), 6) AS hit_1 FROM scores JOIN t USING (qid) GROUP BY ALL",
    "label_diff": "SELECT p_partkey AS qid, CASE WHEN p_partkey % 7 = 0 THEN 'dead' ELSE 'changed' END AS status FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 11 = 0",
    "dead_urls": "WITH u AS (SELECT page_id AS qid, unnest([url, url || 'x']) AS source_url FROM pages) SELECT * FROM u WHERE source_url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)",
    "behaviour_checks": "WITH x AS (" + asked.SQL["intents_by_query"] + "), y AS (SELECT kind, CASE query_id % 9 WHEN 4 THEN 'matchup' WHEN 5 THEN 'counters' WHEN 6 THEN 'build' WHEN 7 THEN 'champion_stats' END AS want FROM x) SELECT count(*) AS n, count(*) FILTER (WHERE kind IS NOT DISTINCT FROM want) AS \"right\", count(*) FILTER (WHERE want IS NULL AND kind IS NOT NULL) AS stray FROM y",
}
QUERIES = {name: globals()[name] for name in SQL}
