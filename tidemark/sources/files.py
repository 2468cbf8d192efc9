"""Readers of markdown trees, game JSON, question sets, match-up payloads and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPELL = "struct<name:string,description:string,cooldown:array<double>,cost:array<double>,range:array<double>,maxrank:int,cooldownBurn:string,costBurn:string,rangeBurn:string>"
CHAMPIONS = f"data map<string,struct<name:string,title:string,tags:array<string>,partype:string,stats:map<string,double>,passive:struct<name:string,description:string>,spells:array<{SPELL}>>>"
ITEMS = "data map<string,struct<name:string,plaintext:string,description:string,gold:struct<total:int,base:int>,stats:map<string,double>,tags:array<string>,maps:map<string,boolean>>>"
SUMMONERS = "data map<string,struct<name:string,description:string,cooldownBurn:string>>"
RUNES = "name string, slots array<struct<runes:array<struct<name:string,shortDesc:string,longDesc:string>>>>"
QUESTION = "question string, type string, topic string, pair_id string, expected_urls array<string>, answer struct<lookup:string,champion:string,slot:string,field:string,item:string,phrase:string,rank:int>, value double, unit string, tolerance double, items array<string>, min_recall double, expect_live string"
COUNTERS = "champion string, lane string, patch string, data struct<counters:array<struct<champion_name:string,play:bigint,win:bigint>>>"
ANALYSIS = "champion string, position string, data struct<summary:struct<average_stats:struct<win_rate:double,pick_rate:double,ban_rate:double,kda:double,tier:int,rank:int,play:bigint>,positions:array<struct<name:string,stats:struct<role_rate:double>>>>,trends:struct<win:struct<version:string,created_at:string>>>"


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(doc_key, text) of every .md file below a folder; the key is the path inside it."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    inside = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/+", "/")
    base = "/" + root.split("://")[-1].lstrip("/").removeprefix("file:/").rstrip("/") + "/"
    return files.select(F.replace(inside, F.lit(base), F.lit("")).alias("doc_key"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets as JSON lines; blank lines and comments are skipped."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", QUESTION).alias("q")).select("q.*")


def read_payloads(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejects) of a JSON-lines file: lines that are no object are rejected."""
    lines = spark.read.text(path).withColumn("p", F.from_json("value", schema)).withColumn("ok", F.trim("value").startswith("{") & F.col("p").isNotNull() & F.get_json_object("value", "$").isNotNull())
    return lines.filter("ok").select("p.*"), lines.filter("not ok").select("value")


def counter_table(payloads: DataFrame) -> DataFrame:
    """Match-up rows (champion, lane, patch, row_no, opponent, play, win) of counter payloads."""
    rows = payloads.select("champion", "lane", "patch", F.posexplode("data.counters").alias("row_no", "c"))
    return rows.select("champion", "lane", "patch", "row_no", F.col("c.champion_name").alias("opponent"), F.col("c.play").alias("play"), F.col("c.win").alias("win"))


def positions_table(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("champion", F.posexplode_outer("data.summary.positions").alias("ord", "p")).filter("ord is not null")
    return rows.select("champion", "ord", F.col("p.name").alias("name"), F.col("p.stats.role_rate").alias("role_rate"))
