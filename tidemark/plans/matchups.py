"""Registered match-up queries: champion is the supplier's nation, opponent the part's brand, a win is a returned line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import matchups as op
from tidemark.plans.tables import longs, table

FLOOR = 80


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines aggregate by part and supplier before they meet the dimensions."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("play"), F.count_if(F.col("l_returnflag") == "R").alias("win"))
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    games = joined.groupBy(F.col("s_nationkey").cast("string").alias("champion"), F.col("p_brand").alias("opponent")).agg(F.sum("play").alias("play"), F.sum("win").alias("win"))
    number = F.regexp_extract("opponent", r"(\d+)$", 1).cast("long")
    return games.select("champion", F.lit("mid").alias("lane"), number.alias("row_no"), "opponent", "play", "win")


def _rated(spark, sf_dir):
    return op.rates(facts(spark, sf_dir), FLOOR)


def _seen(rated: DataFrame) -> DataFrame:
    return op.top(rated).select("champion", "lane", F.upper(F.concat(F.lit(" "), "opponent")).alias("opponent"))


def matchup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_rated(spark, sf_dir))


def matchup_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.top(_rated(spark, sf_dir)).select("champion", "side", "place", "opponent", "my_rate", "play"))


def matchup_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return longs(op.next_page(rated, _seen(rated)).select("champion", "side", "place", "opponent", "my_rate", "play"))


def matchup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return longs(op.status(rated, _seen(rated)))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every champion is asked about every opponent by its whole name, about a piece of names, and about nobody."""
    rated = _rated(spark, sf_dir)
    whole = rated.select("champion", "lane", F.lower("opponent").alias("opponent"))
    part = rated.select("champion", "lane").distinct().withColumn("opponent", F.explode(F.array(F.lit("#3"), F.lit("#nobody"))))
    return longs(op.head_to_head(rated, whole.unionByName(part), FLOOR))


def _positions(spark, sf_dir):
    """Orders of a customer's nation by priority stand for lanes."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = F.create_map(*(F.lit(x) for pair in zip("12345", ("TOP", "jungle", " Mid", "bot", "support"), strict=True) for x in pair))
    counted = orders.groupBy(F.col("c_nationkey").cast("string").alias("champion"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").alias("n"))
    total = counted.groupBy("champion").agg(F.sum("n").alias("all"))
    return counted.join(total, "champion").select("champion", F.col("p").cast("int").alias("ord"), names[F.col("p")].alias("name"), (F.col("n") / F.col("all")).alias("role_rate"))


def primary_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.primary_lane(_positions(spark, sf_dir)))


def role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(op.role_split(_positions(spark, sf_dir)))


def max_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users level the skill that their event's type stands for."""
    skill = F.substring("event_type", 1, 1)
    return op.max_order(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("champion"), F.col("event_id").alias("level"), F.when(skill == "p", "R").otherwise(F.col("event_type")).alias("skill")))


_FACTS = f"""WITH facts AS (SELECT s_nationkey::VARCHAR AS champion, 'mid' AS lane, regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS row_no, p_brand AS opponent, count(*) AS play, count(*) FILTER (WHERE l_returnflag = 'R') AS win
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
 rated AS (SELECT *, round(100 - my_rate, 1) AS opp_rate, play >= {FLOOR} AS counts FROM (SELECT *, round(win::DOUBLE / play * 100, 1) AS my_rate FROM facts WHERE coalesce(play, 0) <> 0 AND win IS NOT NULL)),
 sided AS (SELECT *, CASE WHEN my_rate < 50 THEN 'weak' WHEN my_rate > 50 THEN 'strong' END AS side FROM rated WHERE counts),
 placed AS (SELECT *, row_number() OVER (PARTITION BY champion, lane, side ORDER BY CASE WHEN side = 'weak' THEN my_rate ELSE -my_rate END, row_no) AS place FROM sided WHERE side IS NOT NULL),
 rest AS (SELECT * EXCLUDE place, row_number() OVER (PARTITION BY champion, lane, side ORDER BY CASE WHEN side = 'weak' THEN my_rate ELSE -my_rate END, row_no) AS place FROM placed WHERE place > 5)"""
_LANES = """WITH counted AS (SELECT c_nationkey::VARCHAR AS champion, left(o_orderpriority, 1) AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 pos AS (SELECT champion, p::INT AS ord, CASE p WHEN '1' THEN 'top' WHEN '2' THEN 'jungle' WHEN '3' THEN 'mid' WHEN '5' THEN 'support' END AS lane, n::DOUBLE / sum(n) OVER (PARTITION BY champion) AS rate FROM counted)"""
SQL = {
    "matchup_rates": f"{_FACTS} SELECT * FROM rated",
    "matchup_top5": f"{_FACTS} SELECT champion, side, place, opponent, my_rate, play FROM placed WHERE place <= 5",
    "matchup_next_page": f"{_FACTS} SELECT champion, side, place, opponent, my_rate, play FROM rest WHERE place <= 5",
    "matchup_status": f"""{_FACTS}, totals AS (SELECT champion, lane, count(*) AS total, count(*) FILTER (WHERE NOT counts) AS below_floor FROM rated GROUP BY ALL),
 sidesof AS (SELECT *, unnest(['weak', 'strong']) AS side FROM totals), x AS (SELECT s.*, (SELECT count(*) FROM placed p WHERE p.champion = s.champion AND p.lane = s.lane AND p.side = s.side) AS on_side,
 (SELECT count(*) FROM rest p WHERE p.champion = s.champion AND p.lane = s.lane AND p.side = s.side) AS "left" FROM sidesof s)
 SELECT *, CASE WHEN "left" > 0 THEN 'rows' WHEN on_side > 0 THEN 'exhausted' WHEN total = below_floor THEN 'under_floor' ELSE 'none_on_side' END AS status FROM x""",
    "head_to_head": f"""{_FACTS}, asked AS (SELECT champion, lane, lower(opponent) AS asked FROM rated UNION SELECT champion, lane, unnest(['#3', '#nobody']) FROM (SELECT DISTINCT champion, lane FROM rated)),
 met AS (SELECT a.*, r.opponent, r.my_rate, r.play, row_number() OVER (PARTITION BY a.champion, a.lane, a.asked ORDER BY lower(trim(r.opponent)) <> a.asked, r.row_no) AS k FROM asked a JOIN rated r ON a.champion = r.champion AND a.lane = r.lane AND contains(lower(trim(r.opponent)), a.asked))
 SELECT a.champion, a.lane, a.asked, m.opponent, m.my_rate, m.play, coalesce(m.play < {FLOOR}, false) AS thin, m.opponent IS NOT NULL AS found FROM asked a LEFT JOIN met m ON a.champion = m.champion AND a.lane = m.lane AND a.asked = m.asked AND m.k = 1""",
    "primary_lane": f"{_LANES} SELECT champion, lane, 'discovered' AS provenance FROM (SELECT *, row_number() OVER (PARTITION BY champion ORDER BY rate DESC, ord) AS k FROM pos WHERE lane IS NOT NULL) WHERE k = 1",
    "role_split": f"{_LANES} SELECT champion, lane, share, row_number() OVER (PARTITION BY champion ORDER BY share DESC, ord) AS place FROM (SELECT champion, lane, ord, round(rate * 100, 1) AS share FROM pos WHERE lane IS NOT NULL)",
    "max_order": "SELECT user_id::VARCHAR AS champion, list_slice(list(skill ORDER BY level), 1, 3) AS skills FROM (SELECT user_id, CASE WHEN left(event_type, 1) = 'p' THEN 'R' ELSE event_type END AS skill, min(event_id) AS level FROM events GROUP BY ALL) WHERE upper(skill) <> 'R' GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
