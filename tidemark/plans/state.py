"""Registered session and log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import fresh_folder
from tidemark.plans.tables import longs, table
from tidemark.streaming import sessions


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, at most three in three days."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return sessions.admissions(events, 3 * 86400, 3)


def referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.is_referential(body).alias("referential"), sessions.wants_more(body).alias("more"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: the first of a conversation asks for counters, later ones point back when their number says so. Every other question names no lane, and the answer has one."""
    n, kind = F.col("turn"), F.col("conv_id") % 3
    none = F.lit(None).cast("string")
    lane = F.when(F.col("conv_id") % 2 == 0, "top")
    own = F.when(n == 0, F.struct(F.lit("counters").alias("kind"), F.concat(F.lit("champ"), kind.cast("string")).alias("a"), lane.alias("position"), F.lit("weak").alias("direction")))
    turn = F.struct(F.lit("game").alias("corpus"), F.lit("16.15.1").alias("patch"), (n * 200 + 1).alias("ts"), own.alias("own"), none.alias("carried"), F.array().cast("array<string>").alias("named"), (n % 4 != 3).alias("referential"), (kind == 1).alias("more"), F.array(F.concat(F.lit("opp"), n.cast("string"))).alias("answered"), F.lit("mid").alias("lane"))
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), F.to_json(turn, {"ignoreNullFields": "false"}).alias("body"))


def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.followups(_turns(spark, sf_dir)).withColumn("exclude", F.array_join("exclude", ","))


def followups_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turns as a stream of files, dealt without regard to their order, in about four triggers; an event long after them brings the last ones out."""
    turns, folder = _turns(spark, sf_dir), fresh_folder(spark, "turns")
    files = max(4, turns.rdd.getNumPartitions())
    turns.repartition(files).write.parquet(f"{folder}/in")
    spark.range(1).select(F.lit("").alias("session_id"), F.lit(0).cast("long").alias("turn"), F.lit('{"ts": 1000000000}').alias("body")).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/in")
    sink = sessions.stream_followups(source, "30 days").filter("session_id <> ''").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions.FOLLOWUPS).parquet(f"{folder}/out").withColumn("exclude", F.array_join("exclude", ","))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines and read again; purchases are cut off and drop out."""
    e = table(spark, sf_dir, "events")
    stage = lambda k: F.round(F.col("value") * k, 3)
    latency = F.struct(stage(1).alias("embed"), stage(2).alias("retrieve"), stage(3).alias("rerank"), F.lit(0.0).alias("mcp"), stage(4).alias("generation"), F.round(F.col("value") * 10, 3).alias("total"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("question"), F.lit("ask").alias("event"), F.col("event_type").alias("corpus"), F.get_json_object("props", "$.k").cast("int").alias("n_sources"), (F.col("value") < 10).alias("refused"), latency.alias("latency_ms")))
    lines = e.select(F.when(F.col("event_type") == "purchase", F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return longs(sessions.parse_log(lines).select("question", "corpus", "n_sources", "refused", F.round("total_ms", 2).alias("total_ms"), "total_ok"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(q, ' {w} ')" for w in words) + ")"


SQL = {
    "admission": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s AS (SELECT key, seq, n, [ts] AS hits, true AS admitted, 0::BIGINT AS retry_after FROM e WHERE n = 1
  UNION ALL SELECT key, seq, n, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END, len(k) < 3, CASE WHEN len(k) < 3 THEN 0 ELSE floor(259200 - (ts - k[1]))::BIGINT + 1 END
  FROM (SELECT e.key, e.seq, e.n, e.ts, list_filter(s.hits, lambda x: x >= e.ts - 259200) AS k FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
 SELECT key, seq, admitted, retry_after FROM s""",
    "followups": """WITH RECURSIVE u AS (SELECT conv_id, turn::BIGINT AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
 s AS (SELECT conv_id, turn, k, turn = 0 AS ok, CASE WHEN turn = 0 THEN 0::BIGINT END AS ts, CASE WHEN turn = 0 THEN 'opp0' END AS mentioned, NULL::VARCHAR AS exclude FROM u WHERE k = 1
  UNION ALL SELECT conv_id, turn, k, ok, CASE WHEN ok THEN turn * 200 ELSE ts END, CASE WHEN ok AND more THEN mentioned || ',opp' || turn WHEN ok THEN 'opp' || turn ELSE mentioned END, CASE WHEN ok AND more THEN mentioned END
  FROM (SELECT u.conv_id, u.turn, u.k, s.ts, s.mentioned, u.conv_id % 3 = 1 AS more, u.turn % 4 <> 3 AND s.ts IS NOT NULL AND u.turn * 200 - s.ts <= 600 AS ok FROM s JOIN u ON u.conv_id = s.conv_id AND u.k = s.k + 1))
 SELECT conv_id::VARCHAR AS session_id, turn, CASE WHEN ok THEN 'counters' END AS kind, CASE WHEN ok THEN 'champ' || (conv_id % 3) END AS a, NULL::VARCHAR AS b, CASE WHEN ok AND conv_id % 2 = 0 THEN 'top' WHEN ok AND turn <> 0 THEN 'mid' END AS position, CASE WHEN ok THEN 'weak' END AS direction, NULL::BOOLEAN AS role_query, exclude, ok AND turn <> 0 AS followup FROM s""",
    "referential": f"WITH x AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS q FROM conversations) SELECT conv_id, turn, {_has(sessions.PRONOUNS + sessions.DEMONSTRATIVES + sessions.ELLIPSIS)} AS referential, {_has(sessions.MORE)} AS more FROM x",
    "request_log": "SELECT event_id::VARCHAR AS question, event_type AS corpus, json_extract(props, '$.k')::BIGINT AS n_sources, value < 10 AS refused, round(round(value, 3) + round(value * 2, 3) + round(value * 3, 3) + round(value * 4, 3), 2) AS total_ms, true AS total_ok FROM events WHERE event_type <> 'purchase'",
}
SQL["followups_stream"] = SQL["followups"]
QUERIES = {name: globals()[name] for name in SQL}
