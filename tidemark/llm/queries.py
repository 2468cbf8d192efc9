"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as it reads back from the shards, with the documents that it holds."""
    from tidemark.llm.order import packed_records, read_shards, record_digests, write_shards
    from tidemark.llm.shared import fresh_folder

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "order")
    write_shards(docs, path)
    index = packed_records(docs)[0].select("slot", "n_ids", "doc_ids")
    return record_digests(read_shards(spark, path)).join(index, "slot")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import format_turns, read_back

    both = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(added)))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import lm

    docs = table(spark, sf_dir, "documents")
    scored = lm.score_texts(docs, ~lm.held_out())
    return scored.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import compression_bands

    return compression_bands(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, held against the document as it is or, for every seventh, with another n_chars."""
    from tidemark.llm import manifest
    from tidemark.llm.shared import fresh_folder

    folder, columns = fresh_folder(spark, "manifest"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = manifest.leaf_digest(*columns[:3], F.col("n_chars") + 1, columns[4])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    manifest.write_manifest(table(spark, sf_dir, "documents"), folder, {"claimed": F.unhex(claimed)})
    found = manifest.proofs(spark, folder)
    claim = F.coalesce(F.lower(F.hex("claimed")), F.col("leaf"))
    out = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("siblings")).alias("proof_sha256"), manifest.fold(claim, F.col("siblings"), F.col("left")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), byte_model(), with_ids=False)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.align import align_documents

    return align_documents(table(spark, sf_dir, "documents"), byte_model(), piece_model(), with_groups=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: crc32 of a decimal number's characters, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)::UBIGINT[]), lambda p, q: xor(p >> 1, (p & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"


def _manifest_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    up = lambda key, of: f"pos // 2 AS pos, level + 1, sha256(h || coalesce(later, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY {key} ORDER BY pos) AS later, count(*) OVER (PARTITION BY {key}) AS n FROM {of}) WHERE n > 1 AND pos % 2 = 0"
    step = lambda pos: f"CASE WHEN b.h IS NULL THEN '.' WHEN ({pos}) % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END AS step"
    return f"""WITH RECURSIVE d AS (SELECT *, {leaf("n_chars")} AS leaf, CASE WHEN {_CRC.format(x="doc_id")} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS claimed FROM documents),
 l AS (SELECT doc_id, leaf, claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
 t AS (SELECT tree, pos, 0 AS level, leaf AS h FROM l UNION ALL SELECT tree, {up("tree", "t")}),
 e AS (SELECT tree, arg_max(h, level) AS subroot, max(level) AS height FROM t GROUP BY 1),
 r AS (SELECT tree AS pos, 0 AS level, subroot AS h FROM e UNION ALL SELECT {up("level", "r")}),
 w AS (SELECT arg_max(h, level) AS root, max(level) AS height FROM r),
 low AS (SELECT l.tree, l.pos, unnest(range(height)) AS level FROM l JOIN e USING (tree)),
 high AS (SELECT tree, unnest(range((SELECT height FROM w))) AS level FROM e),
 s AS (SELECT low.tree, low.pos, low.level, {step("low.pos >> low.level")} FROM low LEFT JOIN t b ON b.tree = low.tree AND b.level = low.level AND b.pos = xor(low.pos >> low.level, 1)
  UNION ALL SELECT l.tree, l.pos, 1000 + high.level, {step("high.tree >> high.level")} FROM l JOIN high USING (tree) LEFT JOIN r b ON b.level = high.level AND b.pos = xor(high.tree >> high.level, 1)),
 p AS (SELECT tree, pos, list(step ORDER BY level) AS steps FROM s GROUP BY ALL),
 o AS (SELECT doc_id, leaf, subroot, root, claimed, coalesce(steps, []) AS steps FROM l JOIN e USING (tree) LEFT JOIN p USING (tree, pos), w)
 SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: replace(x[2:], '.', '')), '')) AS proof_sha256, f AS folded_root, f = root AS verified
 FROM (SELECT *, list_reduce(list_concat([claimed], steps), lambda a, x: CASE WHEN x = '.' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS f FROM o)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _manifest_sql()}
