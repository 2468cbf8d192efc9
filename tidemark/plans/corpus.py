"""Registered ingestion, slice and vector-check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import chunking, ingest, slices
from tidemark.operators.lineage import fresh_folder
from tidemark.plans.tables import CHUNKS_SQL, chunks, longs, spread, table

DIM = 64


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, removed = text.clean_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", cleaned.alias("cleaned"), removed.alias("removed"))


def doc_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*/?", "")
    named = F.when(F.col("page_id") % 5 == 0, F.concat(path, F.lit("/index.md"))).when(F.col("page_id") % 5 == 1, "index.md").otherwise(F.concat(path, F.lit(".md")))
    return table(spark, sf_dir, "pages").select("page_id", text.doc_url(named, "https://docs.example/").alias("doc_url"))


def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    spec = F.concat(F.lit("3:2,"), (n % 7 + 1).cast("string"), F.lit(",x,"), (n % 3 + 1).cast("string"), F.lit(":"), (n % 5 + 2).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.line_slice(F.split(F.coalesce("text", F.lit("")), "\n"), spec), "\n").alias("chosen"))


def _with_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets two directives behind it, one of a benchmark item and one of nothing."""
    n = F.col("doc_id")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n{* items/"), (n % 50).cast("string"), F.lit('.py ln[1:2] title["Item"] *}\n{* ../outside.py *}\nend'))
    docs = table(spark, sf_dir, "documents").select(n.cast("string").alias("doc_key"), body.alias("text"), F.col("source").alias("corpus"), F.col("lang").alias("doc_version"))
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("body"))
    return ingest.resolve_includes(docs, files)


def include_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_includes(spark, sf_dir).drop("corpus", "doc_version")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_key"), body.alias("text"), F.col("source").alias("source_url"), F.col("lang").alias("doc_version"))
    return longs(chunking.chunk_documents(docs))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```html\n<b>kept</b>  as it is\n```\n"), "html")
    return ingest.clean_documents(table(spark, sf_dir, "pages").select("page_id", fenced.alias("text")))


def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("chunk_id") % 3 == 0, "").when(F.col("chunk_id") % 3 == 1, F.col("heading_path"))
    return chunks(spark, sf_dir).select("chunk_id", ingest.embedding_input(heading, F.col("content")).alias("body"))


def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector is spoilt in one of four ways."""
    e, n = F.col("embedding"), F.col("vec_id") % 40
    spoilt = F.when(n == 0, F.slice(e, 1, 3)).when(n == 10, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(n == 20, F.transform(e, lambda x, i: F.when(i == 2, F.lit(float("nan")).cast("float")).otherwise(x))).when(n == 30, F.lit(None)).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", ingest.vector_fault(spoilt, DIM).alias("reason"))


def vector_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight; in every fifth one index comes twice."""
    all_vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("batch_id"), (F.col("vec_id") % 8).alias("idx"), "vec_id", "embedding")
    back = all_vectors.select("batch_id", F.when((F.col("batch_id") % 5 == 0) & (F.col("idx") == 3), 2).otherwise(F.col("idx")).alias("idx"), F.col("vec_id").alias("returned"))
    pairs, _ = ingest.pair_vectors(all_vectors.select("batch_id", "idx", "vec_id"), back)
    return pairs.select("batch_id", "idx", "vec_id", "returned")


def _measured(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: a text's length and last code point, folded."""
    return [[len(t) % 97, ord(t[-1]) % 89, len(t) % 13 + 1] for t in texts]


def pairing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are stored for all chunks, those of one corpus for the chunk before; five chunks of every slice are embedded anew."""
    every = chunks(spark, sf_dir)
    stored = ingest.embed(every, lambda: _measured).select(F.col("chunk_id").alias("of"), "embedding")
    wanted = every.withColumn("of", F.when(F.col("corpus") == "src1", F.col("chunk_id") + 1).otherwise(F.col("chunk_id"))).join(stored, "of", "left")
    out = ingest.pairing_report(wanted.select(*every.columns, "embedding"), lambda: _measured, 5)
    return out.select("corpus", "doc_version", "n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), "ok")


def embedding_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight through a model that fails where a batch's first text has a length divisible by ten, then what is missing through one that doesn't: which run has stored a chunk."""
    every, folder = chunks(spark, sf_dir), fresh_folder(spark, "vectors")

    def fails(texts: list[str]) -> list[list[float]]:
        if len(texts[0]) % 10 == 0:
            raise RuntimeError("busy")
        return _measured(texts)

    ingest.embed_missing(every, lambda: fails, folder, 8, 3)
    ingest.embed_missing(every, lambda: _measured, folder, 8, 3)
    stored = ingest.stored_vectors(spark, folder, "chunk_id long").filter("reason is null")
    return longs(stored.select("chunk_id", "run", *(F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(3))))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = chunks(spark, sf_dir).withColumn("content", F.when(F.contains("content", F.lit("|")), F.concat("content", F.lit("\n```"))).otherwise(F.col("content")))
    return ingest.audit_sample(fenced, 10, 5).select("chunk_id", "content")


def stamped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.col("chunk_id").cast("string").alias("doc_key"), F.lit(0).alias("chunk_no"))
    return ingest.stamp(docs, "docs", "2.0").select("doc_id", "corpus", "doc_version", "chunk_id")


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that resolve includes and store a chunk for every line: all documents, then those of one corpus again."""
    docs, folder = _with_includes(spark, sf_dir), fresh_folder(spark, "ingested")
    lines = lambda some: some.select("corpus", "doc_version", "doc_key", F.posexplode(F.split("text", "\n")).alias("chunk_no", "content"))
    runs = [ingest.ingest_slices(some, lines, folder) for some in (docs, docs.filter("corpus = 'src1'"))]
    names = ("documents", "resolved", "dropped", "chunks", "replaced")
    return spark.createDataFrame([(k, *(run[name] for name in names)) for k, run in enumerate(runs, 1)], "run long, " + ", ".join(f"{name} long" for name in names))


def embedded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk through the embedder's contract; the model gives a text's length and first code point."""
    out = ingest.embed(chunks(spark, sf_dir), lambda: lambda texts: [[len(t), ord(t[0])] for t in texts])
    return out.select("chunk_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


def _sliced(spark: SparkSession, sf_dir: str, state: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "corpus", "doc_version", F.lit(state).alias("state")).filter("corpus is not null and doc_version is not null")


def slice_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices are written, then those of one corpus anew."""
    path = fresh_folder(spark, "slices")
    slices.replace_slices(_sliced(spark, sf_dir, "old"), path)
    slices.replace_slices(_sliced(spark, sf_dir, "new").filter("corpus = 'src1'"), path)
    return spark.read.parquet(path).select("chunk_id", "corpus", "doc_version", "state")


def slice_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices are written, then every third document anew."""
    path = fresh_folder(spark, "slices")
    slices.replace_slices(_sliced(spark, sf_dir, "old"), path)
    slices.merge_documents(_sliced(spark, sf_dir, "new").filter("chunk_id % 3 = 0"), path, document="chunk_id")
    return spark.read.parquet(path).select("chunk_id", "corpus", "doc_version", "state")


def slice_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = slices.inventory(chunks(spark, sf_dir), ("src1", "src2"))
    return flat.select("corpus", "total", F.array_join(F.transform("versions", lambda v: F.concat_ws("=", v["doc_version"], v["chunks"].cast("string"))), ",").alias("versions"))


def width_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    stored = v.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("corpus"), F.lit("1").alias("doc_version"), F.when((F.col("label") == 3) & (F.col("vec_id") % 2 == 0), F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return longs(slices.width_plan(stored, DIM))


def corpus_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slices.composition(chunks(spark, sf_dir), "/src1")
    return out.withColumn("family_share", F.round("family_share", 6))


def _tags(x: str) -> str:
    return f"regexp_replace({x}, '(?i)</?\\s*(?:{text.TAGS})\\b[^>]*>', ' ', 'g')"


_DROP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', '', 'g'), '(?is)<iframe\\b[^>]*>.*?</iframe\\s*>', '', 'g')"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '\\{\\{[^}]*\\}\\}', '', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g')"
#: The references that stand in the given pages; the operator resolves all of HTML's.
for _name, _value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_value}')"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"
_CLEAN = f"""a AS (SELECT page_id, html, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS x FROM pages), b AS (SELECT page_id, html, {_DROP.format(x='x')} AS x FROM a), c AS (SELECT page_id, html, {_tags('x')} AS x FROM b),
 lines AS (SELECT page_id, html, list_transform(string_split(x, chr(10)), lambda l: regexp_extract(l, '^ *') || regexp_replace(regexp_replace(regexp_replace(l, '^ *', ''), ' {{2,}}', ' ', 'g'), '\\s+$', '')) AS ls FROM c),
 clean AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS cleaned, len(regexp_extract_all(html, '(?s)<!--.*?-->')) + len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>')) + len(regexp_extract_all(html, '(?is)<style\\b[^>]*>.*?</style\\s*>'))
 + len(regexp_extract_all(html, '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>')) + len(regexp_extract_all(html, '(?is)<iframe\\b[^>]*>.*?</iframe\\s*>')) + len(regexp_extract_all(html, '(?i)</?\\s*(?:{text.TAGS})\\b[^>]*>')) AS removed FROM lines)"""
_AUDIT = f"WITH {CHUNKS_SQL}, f AS (SELECT chunk_id, CASE WHEN contains(content, '|') THEN content || chr(10) || '```' ELSE content END AS content FROM chunks)"
_EMBEDDED = f"""WITH {CHUNKS_SQL}, t AS (SELECT *, left(CASE WHEN coalesce(heading_path, '') <> '' THEN heading_path || chr(10) || chr(10) || content ELSE content END, 24000) AS t FROM chunks),
 e AS (SELECT chunk_id, corpus, doc_version, length(t) AS length, [length(t) % 97, unicode(right(t, 1)) % 89, length(t) % 13 + 1]::DOUBLE[] AS v FROM t)"""
SQL = {
    "strip_markup": f"SELECT page_id, trim(regexp_replace({_PLAIN}, '[\\s\\x{{A0}}\\x{{0B}}]+', ' ', 'g')) AS plain FROM pages",
    "clean_html": f"WITH {_CLEAN} SELECT page_id, cleaned, removed FROM clean",
    "clean_documents": f"WITH {_CLEAN} SELECT page_id, '```html' || chr(10) || '<b>kept</b>  as it is' || chr(10) || '```' || chr(10) || cleaned AS text, removed FROM clean",
    "audit_sample": f"{_AUDIT} SELECT chunk_id, content FROM (SELECT * FROM f ORDER BY md5(chunk_id || ':0'), chunk_id LIMIT 10) UNION SELECT chunk_id, content FROM (SELECT * FROM f WHERE contains(content, '```') ORDER BY md5(chunk_id || ':1'), chunk_id LIMIT 5)",
    "stamped_chunks": f"WITH {CHUNKS_SQL} SELECT chunk_id AS doc_id, 'docs' AS corpus, '2.0' AS doc_version, sha256(concat_ws(chr(1), 'docs', '2.0', chunk_id::VARCHAR, '0')) AS chunk_id FROM chunks",
    "ingest_counters": """WITH d AS (SELECT d.source, b.item_id IS NOT NULL AS r, len(string_split(coalesce(d.text, ''), chr(10))) + 1 + CASE WHEN b.item_id IS NULL THEN 0 ELSE 4 + least(2, len(string_split(regexp_replace(b.text, '\\n$', ''), chr(10)))) END AS lines FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50),
 s AS (SELECT 1 AS run, * FROM d UNION ALL SELECT 2, * FROM d WHERE source = 'src1')
 SELECT run::BIGINT AS run, count(*) AS documents, (count(*) FILTER (WHERE r))::BIGINT AS resolved, (2 * count(*) - count(*) FILTER (WHERE r))::BIGINT AS dropped, sum(lines)::BIGINT AS chunks, CASE WHEN run = 2 THEN sum(lines) ELSE 0 END::BIGINT AS replaced FROM s GROUP BY run""",
    "embedded_lengths": f"WITH {CHUNKS_SQL}, b AS (SELECT chunk_id, left(CASE WHEN coalesce(content, '') = '' THEN ' ' ELSE CASE WHEN coalesce(heading_path, '') <> '' THEN heading_path || chr(10) || chr(10) || content ELSE content END END, 24000) AS t FROM chunks) SELECT chunk_id, length(t)::DOUBLE AS first, unicode(t)::DOUBLE AS second FROM b",
    "slice_replace": f"WITH {CHUNKS_SQL} SELECT chunk_id, corpus, doc_version, CASE WHEN corpus = 'src1' THEN 'new' ELSE 'old' END AS state FROM chunks WHERE corpus IS NOT NULL AND doc_version IS NOT NULL",
    "slice_merge": f"WITH {CHUNKS_SQL} SELECT chunk_id, corpus, doc_version, CASE WHEN chunk_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM chunks WHERE corpus IS NOT NULL AND doc_version IS NOT NULL",
    "doc_url": "WITH x AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS p FROM pages), y AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN p || '/index.md' WHEN 1 THEN 'index.md' ELSE p || '.md' END AS p FROM x), z AS (SELECT page_id, regexp_replace(regexp_replace(p, '\\.md$', ''), '(^|/)index$', '') AS s FROM y) SELECT page_id, CASE WHEN s = '' THEN 'https://docs.example/' ELSE 'https://docs.example/' || s || '/' END AS doc_url FROM z",
    "line_slice": """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), y AS (SELECT doc_id, list_concat(list_concat(list_slice(l, 2, 3), list_slice(l, doc_id % 7 + 1, doc_id % 7 + 1)), list_slice(l, least(doc_id % 3 + 1, doc_id % 5 + 2), greatest(doc_id % 3 + 1, doc_id % 5 + 2))) AS c FROM x),
 z AS (SELECT doc_id, c, coalesce(list_max(list_transform(c, lambda s, i: CASE WHEN trim(s) <> '' THEN i ELSE 0 END)), 0) AS k FROM y) SELECT doc_id, coalesce(array_to_string(list_slice(c, 1, k), chr(10)), '') AS chosen FROM z""",
    "include_join": """WITH d AS (SELECT doc_id::VARCHAR AS doc_key, coalesce(d.text, '') AS t, b.text AS body FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50),
 e AS (SELECT *, list_slice(string_split(regexp_replace(body, '\\n$', ''), chr(10)), 1, 2) AS l FROM d)
 SELECT doc_key, t || chr(10) || CASE WHEN body IS NOT NULL THEN 'Item' || chr(10) || chr(10) || '```python' || chr(10) || array_to_string(l, chr(10)) || chr(10) || '```' || chr(10) ELSE '' END || 'end' AS text, CASE WHEN body IS NULL THEN 0 ELSE 1 END::BIGINT AS resolved, CASE WHEN body IS NULL THEN 2 ELSE 1 END::BIGINT AS dropped FROM e""",
    "embedding_input": f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN chunk_id % 3 = 1 THEN heading_path || chr(10) || chr(10) || content ELSE content END AS body FROM chunks",
    "vector_health": "SELECT vec_id, CASE vec_id % 40 WHEN 0 THEN 'width' WHEN 10 THEN 'all zero' WHEN 20 THEN 'not finite' WHEN 30 THEN 'missing' END AS reason FROM embeddings",
    "vector_pairing": "WITH v AS (SELECT vec_id // 8 AS batch_id, vec_id % 8 AS idx, vec_id FROM embeddings) SELECT batch_id, idx, vec_id, vec_id AS returned FROM v WHERE batch_id NOT IN (SELECT batch_id FROM v WHERE batch_id % 5 = 0 AND idx = 3)",
    "pairing_check": f"""{_EMBEDDED}, p AS (SELECT c.chunk_id, c.corpus, c.doc_version, c.v AS fresh, s.v AS stored, row_number() OVER (PARTITION BY c.corpus, c.doc_version ORDER BY md5(c.chunk_id || ':0'), c.chunk_id) AS place FROM e c LEFT JOIN e s ON s.chunk_id = CASE WHEN c.corpus = 'src1' THEN c.chunk_id + 1 ELSE c.chunk_id END),
 x AS (SELECT corpus, doc_version, coalesce(list_cosine_similarity(stored, fresh), 0.0) AS s FROM p WHERE place <= 5)
 SELECT corpus, doc_version, count(*) AS n, round(min(s), 6) AS least, round(avg(s), 6) AS mean, min(s) >= 0.999 AS ok FROM x GROUP BY ALL""",
    "embedding_runs": f"""{_EMBEDDED}, b AS (SELECT *, (row_number() OVER (ORDER BY chunk_id) - 1) // 8 AS batch FROM e), f AS (SELECT batch, arg_min(length, chunk_id) % 10 = 0 AS failed FROM b GROUP BY 1)
 SELECT chunk_id, CASE WHEN failed THEN 2 ELSE 1 END::BIGINT AS run, v[1] AS v0, v[2] AS v1, v[3] AS v2 FROM b JOIN f USING (batch)""",
    "slice_inventory": "WITH c AS (SELECT source AS corpus, lang, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY ALL) SELECT corpus, sum(n)::BIGINT AS total, string_agg(lang || '=' || n, ',' ORDER BY lang) AS versions FROM c GROUP BY 1",
    "width_plan": "WITH v AS (SELECT 'c' || label AS corpus, '1' AS doc_version, CASE WHEN label = 3 AND vec_id % 2 = 0 THEN 32 ELSE len(embedding) END AS w FROM embeddings) SELECT corpus, doc_version, count(*) AS rows, min(w)::BIGINT AS least, max(w)::BIGINT AS most FROM v GROUP BY ALL HAVING min(w) <> 64 OR max(w) <> 64",
    "corpus_composition": f"WITH {CHUNKS_SQL} SELECT corpus, doc_version, count(*) AS chunks, count(*) FILTER (WHERE contains(content, '```')) AS with_code, round(count(*) FILTER (WHERE contains(source_url, '/src1'))::DOUBLE / count(*), 6) AS family_share FROM chunks GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in (*SQL, "chunk_documents")}
