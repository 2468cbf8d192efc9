"""Registered queries on nested game data. Every part is one JSON document of a champion, an item, a rune tree, a summoner spell, an analysis or a set of match-up rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import matchups, slices, snapshots
from tidemark.operators.lineage import fresh_folder
from tidemark.plans.tables import dealt, longs, table
from tidemark.sources import files, game

PATCH = "16.15.1"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


def _n() -> Column:
    return F.col("p_partkey")


def _id() -> Column:
    return _n().cast("string")


def _marked() -> Column:
    return F.concat(F.lit("<b>"), "p_type", F.lit("</b><br>{{ x }}&amp; "), "p_brand")


def _read(spark: SparkSession, sf_dir: str, body: Column, schema: str) -> DataFrame:
    """The parts as JSON text, parsed with a reader's schema."""
    text = _parts(spark, sf_dir).select(F.to_json(body).alias("j"))
    return text.select(F.from_json("j", schema).alias("x")).select("x.*")


def _by_id(**fields: Column) -> Column:
    return F.struct(F.create_map(_id(), F.struct(*(c.alias(k) for k, c in fields.items()))).alias("data"))


def _spell(k: int) -> Column:
    parts = {"name": F.concat(F.lit(f"Spell {k} of "), "p_name"), "description": _marked(), "cooldown": F.array(F.col("p_size") + k, F.col("p_size") * 0.5), "cost": F.array(F.lit(float(k))), "range": F.array(F.lit(500.0)), "maxrank": F.lit(5), "cooldownBurn": F.concat(F.col("p_size").cast("string"), F.lit(f"/{k}"))}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to five spells; every fourth has no tags, and every fifth no words on its passive."""
    spells = F.slice(F.array(*map(_spell, range(1, 6))), 1, (_n() % 3 + 3).cast("int"))
    passive = F.struct(F.concat(F.lit("P "), "p_brand").alias("name"), F.when(_n() % 5 != 0, _marked()).alias("description"))
    tags, stats = F.when(_n() % 4 != 0, F.array("p_type")), F.create_map(F.lit("hp"), F.col("p_size").cast("double"))
    return _read(spark, sf_dir, _by_id(name=F.col("p_name"), title=F.col("p_brand"), tags=tags, partype=F.col("p_type"), stats=stats, passive=passive, spells=spells), files.CHAMPIONS)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.struct(F.when(_n() % 7 == 0, 0).otherwise(F.floor("p_retailprice").cast("int")).alias("total"), F.col("p_size").alias("base"))
    name, maps = F.when(_n() % 11 == 0, "").otherwise(F.col("p_name")), F.create_map(F.lit("11"), _n() % 3 != 0, F.lit("12"), F.lit(True))
    return _read(spark, sf_dir, _by_id(name=name, plaintext=F.when(_n() % 2 == 0, F.col("p_type")), description=_marked(), gold=gold, tags=F.array("p_brand"), maps=maps), files.ITEMS)


def game_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = game.champions(_champions(spark, sf_dir), PATCH)
    return out.select("id", "name", "title", F.array_join("tags", ",").alias("tags"), "partype", F.col("stats")["hp"].alias("hp"))


def game_abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = game.abilities(_champions(spark, sf_dir), PATCH)
    return longs(out.select("champion_id", "slot", "name", "description", F.col("cooldown")[0].alias("first"), F.size("cooldown").alias("ranks"), "max_rank"))


def champion_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game.champion_prose(_champions(spark, sf_dir))


def game_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(game.items(_items(spark, sf_dir), PATCH).select("id", "name", "plaintext", "description", "gold_total", "gold_base", F.size("stats").alias("n_stats"), F.array_join("tags", ",").alias("tags")))


def item_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game.item_prose(game.items(_items(spark, sf_dir), PATCH))


def rune_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two slots; the long text is empty for every third part, and the second rune says nothing."""
    rune = lambda name, short, long: F.struct(name.alias("name"), short.alias("shortDesc"), long.alias("longDesc"))
    slots = F.array(F.struct(F.array(rune(F.col("p_type"), F.col("p_brand"), F.when(_n() % 3 == 0, "").otherwise(_marked())), rune(F.lit("none"), F.lit("<br>"), F.lit(""))).alias("runes")), F.struct(F.array(rune(F.lit("other"), F.col("p_type"), F.lit(None).cast("string"))).alias("runes")))
    return game.rune_prose(_read(spark, sf_dir, F.struct(F.col("p_name").alias("name"), slots.alias("slots")), files.RUNES))


def summoner_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _read(spark, sf_dir, _by_id(name=F.col("p_name"), description=F.when(_n() % 4 != 0, _marked()), cooldownBurn=F.when(_n() % 3 != 0, F.col("p_size").cast("string"))), files.SUMMONERS)
    return game.summoner_prose(raw)


def patch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Champions, abilities and items in two patches, then the second patch of all three anew, without every other row, in one commit: what the snapshots before and after have."""
    folder, every = fresh_folder(spark, "patches"), _parts(spark, sf_dir)
    keyed = every.select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_brand", "p_type")
    ability = keyed.select(F.col("id").alias("champion_id"), F.lit("Q").alias("slot"), F.col("p_type").alias("name"), F.lit(None).cast("array<double>").alias("cooldown"))
    items = game.items(_items(spark, sf_dir), PATCH).select("id", "name", "stats", "tags")
    tables = {"champions": keyed.select("id", F.col("p_brand").alias("name")), "abilities": ability, "items": items}
    both = F.explode(F.array(F.lit("1.10"), F.lit("2.0")))
    first = slices.replace_patch({name: rows.withColumn("patch", both) for name, rows in tables.items()}, folder)
    last = slices.replace_patch({name: rows.withColumn("patch", F.lit("2.0")).filter(F.col(rows.columns[0]).cast("long") % 2 == 0) for name, rows in tables.items()}, folder)
    out = None
    for number, when in ((first, "before"), (last, "after")):
        for name in tables:
            rows = snapshots.read(spark, folder, name, number)
            rows = rows.select(F.lit(when).alias("snapshot"), F.lit(name).alias("table"), "patch", F.col(rows.columns[0]).alias("id"), "name")
            out = rows if out is None else out.unionByName(rows)
    return out


def counter_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files of one line a part, every tenth of them cut off: the rows of those that can be read, with their rates, and the number of rejects behind each."""
    row = lambda name, play, win: F.struct(name.alias("champion_name"), play.alias("play"), win.alias("win"))
    rows = F.array(row(F.col("p_brand"), F.col("p_size").cast("long"), F.floor(F.col("p_size") / 2)), row(F.col("p_type"), F.lit(0).cast("long"), F.lit(0).cast("long")), row(F.lit(None).cast("string"), F.lit(9).cast("long"), F.lit(1).cast("long")))
    line = F.to_json(F.struct(_id().alias("champion"), F.lit("top").alias("lane"), F.lit(PATCH).alias("patch"), F.struct(rows.alias("counters")).alias("data")))
    path = fresh_folder(spark, "payloads")
    _parts(spark, sf_dir).select(F.when(_n() % 10 == 0, F.substring(line, 2, 20)).otherwise(line).alias("value")).write.text(path)
    good, bad = files.read_payloads(spark, path, files.COUNTERS)
    rated = matchups.rates(matchups.counter_rows(files.counter_table(good)), 25)
    return longs(rated.select("champion", "row_no", "opponent", "play", "win", "my_rate", "counts").join(bad.agg(F.count("*").alias("rejects"))))


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("p_size") / 64.0
    average = F.struct(share.alias("win_rate"), F.when(_n() % 3 != 0, share / 2).alias("pick_rate"), F.lit(0.125).alias("ban_rate"), F.when(_n() % 4 != 0, F.col("p_size")).alias("tier"), F.lit(1).alias("rank"), _n().alias("play"))
    place = F.array(F.struct(F.lit("TOP").alias("name"), F.struct(share.alias("role_rate")).alias("stats")), F.struct(F.lit("mid").alias("name"), F.struct(F.lit(0.25).alias("role_rate")).alias("stats")))
    return _read(spark, sf_dir, F.struct(_id().alias("champion"), F.struct(F.struct(average.alias("average_stats"), place.alias("positions")).alias("summary")).alias("data")), files.ANALYSIS)


def analysis_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages in percent, with the fields that a question of statistics misses in them."""
    out = matchups.complete(matchups.averages(_analyses(spark, sf_dir)), "stats")
    return longs(out.select("champion", "win_rate", "pick_rate", "ban_rate", "tier", "rank", "play", "accepted", F.array_join("missing", ",").alias("missing")))


def analysis_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(matchups.primary_lane(files.positions_table(_analyses(spark, sf_dir))))


def build_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = _parts(spark, sf_dir).select(_id().alias("champion"), F.array(F.col("p_name"), F.lit(" "), F.lit(None).cast("string"), F.col("p_brand")).alias("items"), (F.col("p_size") / 64.0).alias("pick_rate"), (_n() % 5 * 8).alias("play"), (_n() % 5).alias("win"))
    return matchups.build_groups(builds).select("champion", F.array_join("items", ",").alias("items"), "pick_rate", "win_rate")


def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question files with comments and blank lines between, read again."""
    path = fresh_folder(spark, "questions")
    line = F.to_json(F.struct(F.col("p_name").alias("question"), F.lit("numeric").alias("type"), F.struct(F.lit("item").alias("lookup"), F.col("p_brand").alias("item")).alias("answer"), _n().cast("double").alias("value")))
    _parts(spark, sf_dir).select(F.when(_n() % 5 == 0, F.concat(F.lit("# "), line)).when(_n() % 5 == 1, " ").otherwise(line).alias("value")).write.text(path)
    return files.read_questions(spark, path).select("question", "type", "answer.lookup", "answer.item", "value")


_PLAIN = "p_type || ' & ' || p_brand"
_P = "FROM part"
_SOLD = "p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND floor(p_retailprice) > 0 AND p_partkey % 3 <> 0"
_SPELLS = f"sp AS (SELECT p_partkey, p_name, p_size, unnest(range(1, least(p_partkey % 3 + 3, 4) + 1)) AS k, {_PLAIN} AS d FROM part)"
SQL = {
    "game_champions": f"SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE '' END AS tags, p_type AS partype, p_size::DOUBLE AS hp {_P}",
    "game_abilities": f"WITH {_SPELLS} SELECT p_partkey::VARCHAR AS champion_id, substr('QWER', k, 1) AS slot, 'Spell ' || k || ' of ' || p_name AS name, d AS description, (p_size + k)::DOUBLE AS first, 2::BIGINT AS ranks, 5::BIGINT AS max_rank FROM sp",
    "champion_prose": f"""WITH {_SPELLS} SELECT p_name || ' — Spell ' || k || ' of ' || p_name || ' (' || substr('QWER', k, 1) || '). ' || d || ' Cooldown ' || p_size || '/' || k || 's · cost ? · range ?.' AS content, p_name || ' > Spell ' || k || ' of ' || p_name || ' (' || substr('QWER', k, 1) || ')' AS heading_path FROM sp
 UNION ALL SELECT p_name || ' — Passive: P ' || p_brand || '. ' || {_PLAIN}, p_name || ' > Passive: P ' || p_brand FROM part WHERE p_partkey % 5 <> 0""",
    "game_items": f"SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS plaintext, {_PLAIN} AS description, floor(p_retailprice)::BIGINT AS gold_total, p_size::BIGINT AS gold_base, 0::BIGINT AS n_stats, p_brand AS tags {_P} WHERE {_SOLD}",
    "item_prose": f"SELECT p_name || ' (item, ' || floor(p_retailprice)::BIGINT || ' gold). ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || '. ' || {_PLAIN} AS content, 'Items > ' || p_name AS heading_path {_P} WHERE {_SOLD}",
    "rune_prose": f"SELECT p_type || ' (rune, ' || p_name || ' tree). ' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE {_PLAIN} END AS content, 'Runes > ' || p_name || ' > ' || p_type AS heading_path {_P} UNION ALL SELECT 'other (rune, ' || p_name || ' tree). ' || p_type, 'Runes > ' || p_name || ' > other' {_P}",
    "summoner_prose": f"SELECT p_name || ' (summoner spell). ' || {_PLAIN} || ' Cooldown ' || CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR ELSE '?' END || 's.' AS content, 'Summoner Spells > ' || p_name AS heading_path {_P} WHERE p_partkey % 4 <> 0",
    "patch_tables": f"""WITH t AS (SELECT 'champions' AS "table", p_partkey AS k, p_brand AS name {_P} UNION ALL SELECT 'abilities', p_partkey, p_type {_P} UNION ALL SELECT 'items', p_partkey, p_name {_P} WHERE {_SOLD}),
 v AS (SELECT 'before' AS snapshot, '1.10' AS patch UNION ALL SELECT 'before', '2.0' UNION ALL SELECT 'after', '1.10' UNION ALL SELECT 'after', '2.0')
 SELECT snapshot, "table", patch, k::VARCHAR AS id, name FROM t, v WHERE snapshot = 'before' OR patch = '1.10' OR k % 2 = 0""",
    "counter_payloads": f"SELECT p_partkey::VARCHAR AS champion, 0::BIGINT AS row_no, p_brand AS opponent, p_size::BIGINT AS play, (p_size // 2)::BIGINT AS win, round((p_size // 2)::DOUBLE / p_size * 100, 1) AS my_rate, p_size >= 25 AS counts, (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) AS rejects {_P} WHERE p_partkey % 10 <> 0 AND p_size > 0",
    "analysis_averages": f"""SELECT p_partkey::VARCHAR AS champion, round(p_size / 64.0::DOUBLE * 100, 1) AS win_rate, CASE WHEN p_partkey % 3 <> 0 THEN round(p_size / 64.0::DOUBLE / 2 * 100, 1) END AS pick_rate, 12.5::DOUBLE AS ban_rate, CASE WHEN p_partkey % 4 <> 0 THEN p_size::BIGINT END AS tier, 1::BIGINT AS rank, p_partkey AS play,
 p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS accepted, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'pick_rate' END, CASE WHEN p_partkey % 4 = 0 THEN 'tier' END) AS missing {_P}""",
    "analysis_lanes": f"SELECT p_partkey::VARCHAR AS champion, CASE WHEN p_size / 64.0 >= 0.25 THEN 'top' ELSE 'mid' END AS lane, 'discovered' AS provenance {_P}",
    "build_groups": f"SELECT p_partkey::VARCHAR AS champion, p_name || ',' || p_brand AS items, round(p_size / 64.0::DOUBLE * 100, 1) AS pick_rate, CASE WHEN p_partkey % 5 <> 0 THEN 12.5::DOUBLE END AS win_rate {_P}",
    "question_sets": f"SELECT p_name AS question, 'numeric' AS type, 'item' AS lookup, p_brand AS item, p_partkey::DOUBLE AS value {_P} WHERE p_partkey % 5 > 1",
}
QUERIES = {name: globals()[name] for name in SQL}
