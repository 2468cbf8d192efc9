"""Document ingestion: includes, HTML cleanup, stamping, counters, embedding contract and pairing checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_markdown, line_slice
from tidemark.operators.lineage import numbered
from tidemark.operators.snapshots import latest, publish, rows_of, write_slices

MOST_CHARS = 24_000
#: A whole-line include directive, its options, and fence languages by file suffix.
INCLUDE = r"^\s*\{\*\s*(\S+)\s*(.*?)\s*\*\}\s*$"
LINES_OPTION, TITLE_OPTION = r"ln\[([0-9:,\s]+)\]", r"""title\[\s*["']([^"']*)["']\s*\]"""
LANGUAGES = {"py": "python", "sh": "bash", "bash": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "dockerfile": "dockerfile"}


def fence_language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[suffix], suffix)


def include_block(path: Column, body: Column, options: Column) -> Column:
    """Fenced code of an included file with its caption; null if nothing is selected."""
    spec = F.regexp_extract(options, LINES_OPTION, 1)
    lines = F.split(F.regexp_replace(body, r"\n$", ""), "\n")
    whole = line_slice(lines, F.concat(F.lit("1:"), F.size(lines).cast("string")))
    chosen = F.when(spec == "", whole).otherwise(line_slice(lines, spec))
    title = F.regexp_extract(options, TITLE_OPTION, 1)
    caption = F.when(title != "", F.concat(title, F.lit("\n\n"))).otherwise("")
    return F.when(F.size(chosen) > 0, F.concat(caption, F.lit("```"), fence_language(path), F.lit("\n"), F.array_join(chosen, "\n"), F.lit("\n```")))


def resolve_includes(docs: DataFrame, files: DataFrame) -> DataFrame:
    """`docs` (doc_key, text, ...) with include lines replaced by the files (path, body) they name, and `resolved` and `dropped` counts.

    Only texts with a directive are taken apart, each different one once; rows that share a doc_key or a text stay rows of their own.
    Paths that leave the root match no file. Lines whose file or selection is missing are dropped.
    """
    some = F.coalesce(F.col("text").rlike(f"(?m){INCLUDE}"), F.lit(False))
    plain = docs.filter(~some).withColumns({"resolved": F.lit(0).cast("long"), "dropped": F.lit(0).cast("long")})
    named = docs.filter(some).withColumn("__text_id", F.sha2("text", 256))
    lines = named.select("__text_id", "text").dropDuplicates(["__text_id"]).select("__text_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    path = F.regexp_replace(F.regexp_extract("line", INCLUDE, 1), r"^(\./)+", "")
    asked = lines.withColumns({"is_include": F.col("line").rlike(INCLUDE), "path": F.when(F.col("line").rlike(INCLUDE), path), "options": F.regexp_extract("line", INCLUDE, 2)})
    met = asked.join(files.select("path", "body"), "path", "left").withColumn("block", include_block(F.col("path"), F.col("body"), F.col("options")))
    new = F.when(F.col("is_include"), F.col("block")).otherwise(F.col("line"))
    built = met.groupBy("__text_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(new.isNotNull(), F.struct("at", new.alias("l"))))), lambda x: x["l"]), "\n").alias("__text"),
        F.count_if(F.col("is_include") & F.col("block").isNotNull()).alias("resolved"),
        F.count_if(F.col("is_include") & F.col("block").isNull()).alias("dropped"),
    )
    fixed = named.join(built, "__text_id").withColumn("text", F.col("__text"))
    return plain.unionByName(fixed.select(*plain.columns))


def clean_documents(docs: DataFrame) -> DataFrame:
    """`docs` with cleaned `text` and the `removed` count."""
    cleaned, removed = clean_markdown(F.col("text"))
    return docs.withColumns({"text": cleaned, "removed": removed})


def stamp(chunks: DataFrame, corpus: str, doc_version: str) -> DataFrame:
    """Chunks with their slice and an id that a retry gives again."""
    stamped = chunks.withColumns({"corpus": F.lit(corpus), "doc_version": F.lit(doc_version)})
    return stamped.withColumn("chunk_id", F.sha2(F.concat_ws("\u0001", "corpus", "doc_version", "doc_key", F.col("chunk_no").cast("string")), 256))


def embedding_input(heading: Column, content: Column) -> Column:
    return F.when(F.length(F.coalesce(heading, F.lit(""))) > 0, F.concat_ws("\n\n", heading, content)).otherwise(content)


def embed(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column | None = None) -> DataFrame:
    """`chunks` with `embedding` by a model that `embedder()` loads once per task. Inputs are clipped, and empty ones are a space."""
    body = embedding_input(F.col("heading_path"), F.col("content")) if text is None else text
    clipped = F.substring(F.when(F.coalesce(body, F.lit("")) == "", " ").otherwise(body), 1, MOST_CHARS)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in series:
            vectors = model(texts.tolist())
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors came back for {len(texts)} inputs")
            yield pd.Series([list(map(float, v)) for v in vectors])

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(clipped))


def pair_vectors(inputs: DataFrame, returned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected batches): inputs (batch_id, idx, ...) with the vector (batch_id, idx, embedding) of the same index, where the indexes of a batch are exactly 0 to n-1."""
    n = inputs.groupBy("batch_id").agg(F.count("*").alias("n"))
    got = returned.groupBy("batch_id").agg(F.count("*").alias("got"), F.count_distinct("idx").alias("different"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    good = (F.col("got") == F.col("n")) & (F.col("different") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    judged = n.join(got, "batch_id", "left").withColumn("ok", F.coalesce(good, F.lit(False)))
    fine = judged.filter("ok").select("batch_id")
    return inputs.join(fine, "batch_id", "left_semi").join(returned, ["batch_id", "idx"]), judged.filter("not ok").drop("ok")


def vector_fault(embedding: Column, dim: int) -> Column:
    """Why a vector can't be stored, or null."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        F.when(embedding.isNull(), "missing").when(F.size(embedding) != dim, "width").when(F.exists(embedding, bad), "not finite").when(~F.exists(embedding, lambda x: x != 0), "all zero")
    )


def split_vectors(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    judged = vectors.withColumn("reason", vector_fault(F.col("embedding"), dim))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def cosine(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def slice_samples(chunks: DataFrame, n: int, keys: tuple[str, ...] = ("corpus", "doc_version"), id_: str = "chunk_id", seed: int = 0) -> DataFrame:
    """(keys, id): n rows of every slice, the least by a hash of the id, the same on every run. Tasks keep n of each slice that they read and merge these, so nothing is sorted as a whole."""
    mark = F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}")))
    least = F.row_number().over(Window.partitionBy(*keys).orderBy("mark", id_))
    return chunks.select(*keys, id_, mark.alias("mark")).withColumn("place", least).filter(F.col("place") <= n).select(*keys, id_)


def pairing_report(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], n: int, least: float = 0.999, keys: tuple[str, ...] = ("corpus", "doc_version"), seed: int = 0) -> DataFrame:
    """(keys, n, least, mean, ok) of every slice: n of its chunks (chunk_id, heading_path, content, embedding) are embedded anew and held against the stored vectors by cosine.

    A missing or zero stored vector scores 0. A slice whose vectors belong to other chunks is not ok.
    """
    drawn = slice_samples(chunks, n, keys, seed=seed)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*keys, "chunk_id")]
    met = chunks.alias("c").join(drawn.alias("d"), reduce(and_, same), "left_semi").withColumnRenamed("embedding", "stored")
    scored = embed(met, embedder).select(*keys, F.coalesce(cosine(F.col("stored"), F.col("embedding")), F.lit(0.0)).alias("s"))
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.min("s").alias("least"), F.avg("s").alias("mean"))
    return out.withColumn("ok", F.coalesce((F.col("least") >= least) & ~F.isnan("least"), F.lit(False)))


def draw(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of `key`: a sample that is the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def audit_sample(chunks: DataFrame, n: int, m: int, seed: int = 0) -> DataFrame:
    """n chunks and m chunks with code, drawn independently, each once."""
    code = chunks.filter(F.contains("content", F.lit("```")))
    return draw(chunks, n, "chunk_id", seed).unionByName(draw(code, m, "chunk_id", seed + 1)).dropDuplicates(["chunk_id"])


def embed_batches(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], path: str, size: int, dim: int, id_: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(stored, refused) of one stage over batches of `size` chunks in the order of their id, written under `path`, a new folder: vectors (id, batch_id, embedding) of good batches, and (batch_id, reason, n) of refused ones.

    A batch is refused whole if the model fails, gives another number of vectors, or gives one that can't be stored; others don't notice. The stage runs once, both outputs are read from what it wrote.
    """
    body = embedding_input(F.col("heading_path"), F.col("content"))
    clipped = F.substring(F.when(F.coalesce(body, F.lit("")) == "", " ").otherwise(body), 1, MOST_CHARS)
    placed = numbered(chunks.select(id_, clipped.alias("text")), F.col(id_)).withColumn("batch_id", F.floor((F.col("ord") - 1) / size).cast("long"))
    kind = chunks.schema[id_].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        try:
            vectors = [list(map(float, v)) for v in embedder()(rows["text"].tolist())]
            reason = None if len(vectors) == len(rows) else f"{len(vectors)} vectors came back for {len(rows)} inputs"
            for v in vectors:
                fault = "width" if len(v) != dim else "not finite" if not all(map(math.isfinite, v)) else "all zero" if not any(v) else None
                reason = reason or fault
        except Exception as failed:  # the model's own: whatever it is, it refuses this batch only
            reason, vectors = f"{type(failed).__name__}: {failed}", []
        out = rows[[id_, "batch_id"]].copy()
        out["embedding"] = vectors if reason is None else [None] * len(rows)
        out["reason"] = reason
        return out

    placed.groupBy("batch_id").applyInPandas(run, f"{id_} {kind}, batch_id long, embedding array<float>, reason string").write.parquet(path)
    done = chunks.sparkSession.read.parquet(path)
    refused = done.filter("reason is not null").groupBy("batch_id", "reason").agg(F.count("*").alias("n"))
    return done.filter("reason is null").drop("reason"), refused


def embed_missing(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], folder: str, size: int, dim: int, id_: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """`embed_batches` of the chunks that no earlier run in `folder` has a vector of: (this run's vectors, its refused batches). Runs are `run=<number>` in it; all vectors are those of `stored_vectors`."""
    stored = stored_vectors(chunks.sparkSession, folder, f"{id_} {chunks.schema[id_].dataType.simpleString()}")
    number = (stored.agg(F.max("run")).first()[0] or 0) + 1
    return embed_batches(chunks.join(stored.filter("reason is null").select(id_), id_, "left_anti"), embedder, f"{folder}/run={number}", size, dim, id_)


def stored_vectors(spark: SparkSession, folder: str, id_: str) -> DataFrame:
    """(id, batch_id, embedding, reason, run) of all runs; `id_` is the id's column and type."""
    schema = f"{id_}, batch_id long, embedding array<float>, reason string, run int"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_counters(docs: DataFrame) -> DataFrame:
    """Sums of the counters that the steps leave on documents."""
    return docs.agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in _STEPS if c in docs.columns))


_STEPS = ("resolved", "dropped", "removed")


def ingest_slices(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, keys: tuple[str, ...] = ("corpus", "doc_version")) -> dict[str, int]:
    """Makes chunks of `docs` by `transform`, puts their slices into the snapshots of `folder`, and gives the counters of that very run: documents, what the steps have counted on them, chunks, and replaced rows.

    Counters are observed on the plan that writes, which reads its input once; what was replaced stands in the manifest. A task that is repeated counts once.
    """
    read, made = Observation(), Observation()
    counted = docs.observe(read, F.count(F.lit(1)).alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STEPS if c in docs.columns))
    chunks = transform(counted).observe(made, F.count(F.lit(1)).alias("chunks"))
    entries = write_slices(chunks, folder, "chunks", keys)
    if made.get["chunks"] == 0:
        raise ValueError("nothing to write: the stored slices stay as they are")
    before = latest(docs.sparkSession, folder)
    replaced = rows_of(docs.sparkSession, folder, before).join(entries.select("name", "slice"), ["name", "slice"], "left_semi").agg(F.sum("rows")).first()[0]
    publish(entries, folder, before)
    return {**read.get, **made.get, "replaced": replaced or 0}
