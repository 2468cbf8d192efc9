"""Registered linking, intent and lookup queries. Parts stand for the roster: names of even length are champions, the others items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, intents, lookups, roster
from tidemark.plans.tables import longs, table

PATCH = "16.15.1"


def _parts(spark, sf_dir, odd: bool) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter(F.length("p_name") % 2 == int(odd))
    return parts.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit(PATCH).alias("patch"), "p_type", "p_size", "p_brand", "p_retailprice")


def _aliases(spark, sf_dir) -> DataFrame:
    """First words and other short names of champions, some of them wrong on purpose."""
    rows = _parts(spark, sf_dir, False)
    n = F.col("id").cast("long")
    alias = F.when(n % 5 == 0, F.substring("name", 1, 1)).when(n % 5 == 1, F.col("name")).otherwise(F.split("name", " ")[0])
    return rows.select(alias.alias("alias"), F.when(n % 5 == 2, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), n.alias("ord"))


def _dictionary(spark, sf_dir) -> DataFrame:
    return roster.build_dictionary(_parts(spark, sf_dir, False).select("id", "name", "patch"), _aliases(spark, sf_dir), _parts(spark, sf_dir, True))


def _asked(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    both = parts.join(parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey", "left")
    kind, name = F.col("p_partkey") % 9, F.col("p_name")
    text = (
        F.when(kind == 0, F.concat(F.lit("What is the cooldown of "), name, F.lit("'s Q at rank "), (F.col("p_size") % 6).cast("string"), F.lit("?")))
        .when(kind == 1, F.concat(F.lit("how much does "), name, F.lit(" cost")))
        .when(kind == 2, F.concat(name, F.lit(" base stats")))
        .when(kind == 3, F.concat(F.lit("which items give lethality and armor penetration? "), F.col("p_brand")))
        .when(kind == 4, F.concat(F.lit("Who wins "), name, F.lit(" vs "), F.coalesce("other", F.lit("nobody")), F.lit(" mid")))
        .when(kind == 5, F.concat(F.lit("what jungler is "), name, F.lit(" good against")))
        .when(kind == 6, F.concat(F.lit("what should I build on "), name, F.lit(" top")))
        .when(kind == 7, F.concat(F.lit("what lane does "), name, F.lit(" play, is it popular?")))
        .otherwise(F.concat(F.lit("how does "), name, F.lit(" build up the passive ultimate armor?")))
    )
    return both.select(F.col("p_partkey").alias("query_id"), text.alias("query"))


def _linked(spark, sf_dir) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return intents.classify(roster.mentions(asked, roster.link_entities(asked, _dictionary(spark, sf_dir))))


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit(PATCH).alias("patch"))
    return roster.canonical(rows).select("id", "name", "kept")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("corpus"), F.concat_ws(".", F.lit("16"), F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string")).alias("patch"))
    return roster.latest_version(rows, ["corpus"]).join(roster.latest_version(rows, ["corpus"], lexical=True).withColumnRenamed("latest", "latest_text"), "corpus")


def roster_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    champions = roster.canonical(_parts(spark, sf_dir, False)).filter("kept")
    kept, problems = roster.resolve_aliases(_aliases(spark, sf_dir), champions.select("id", "name"))
    return kept.select("alias", "id", F.lit("kept").alias("reason")).unionByName(problems)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_dictionary(spark, sf_dir))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(roster.link_entities(_asked(spark, sf_dir), _dictionary(spark, sf_dir)))


def branch_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_linked(spark, sf_dir).select("query_id", "slot", "rank", "numeric", "phrase", "field", "branch"))


def intents_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_linked(spark, sf_dir).select("query_id", "intent.kind", "intent.a", "intent.b", "intent.position", "intent.direction", "intent.role_query"))


def _abilities(spark, sf_dir) -> DataFrame:
    n = F.col("p_size") % 4 + 1
    values = lambda f: F.transform(F.sequence(F.lit(1), n), lambda i: (F.col("p_retailprice") * f / i))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("champion_id"), F.lit("Q").alias("slot"), F.lit(PATCH).alias("patch"), F.col("p_name").alias("name"), values(1.0).alias("cooldown"), values(2.0).alias("cost"), values(3.0).alias("range"))


def ability_rank_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("rank").cast("string")).alias("query_id"), F.col("s_suppkey").cast("string").alias("champion_id"), F.when(F.col("s_suppkey") % 10 == 0, "W").otherwise("Q").alias("slot"), F.lit(PATCH).alias("patch"), "rank")
    out = lookups.ability_values(asked, _abilities(spark, sf_dir))
    return longs(out.select("query_id", "name", *(F.round(c, 4).alias(c) for c in ("cooldown", "cost", "range"))))


def _items(spark, sf_dir) -> DataFrame:
    stat = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("% Armor Penetration"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" Lethality"))).otherwise("10 Armor")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit(PATCH).alias("patch"), F.col("p_name").alias("name"), F.col("p_brand").alias("plaintext"), stat.alias("description"), F.floor("p_retailprice").cast("int").alias("gold_total"), F.array(F.when(F.col("p_type") == "ECONOMY", "ArmorPenetration").otherwise(F.col("p_type"))).alias("tags"))


def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit(PATCH).alias("patch"), F.when(F.col("p_partkey") % 7 == 0, "no such thing").otherwise(F.upper("p_name")).alias("item"))
    return longs(lookups.item_by_name(asked, _items(spark, sf_dir)).select("query_id", "id", "name", "gold_total"))


def items_with_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.items_with_stat(_items(spark, sf_dir), _phrases(spark))
    value = F.when(F.col("phrase") == "lethality", lookups.stat_value(F.col("description"), "lethality")).otherwise(lookups.stat_value(F.col("description"), "armor penetration"))
    return longs(found.select("phrase", "name", "gold_total", value.alias("value"), "place", "total"))


def _champions(spark, sf_dir) -> DataFrame:
    """Parts of even name length with stats; every third has no resource, and every fifth no hit points."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("double")
    stats = F.map_filter(F.create_map(F.lit("hp"), F.when(n % 5 != 0, size + 500), F.lit("hpperlevel"), n % 7 + 0.5, F.lit("mp"), F.when(n % 2 == 0, size * 10).otherwise(0.0), F.lit("armor"), size / 2, F.lit("movespeed"), F.lit(330.0)), lambda k, v: v.isNotNull())
    parts = table(spark, sf_dir, "part").filter(F.length("p_name") % 2 == 0)
    return parts.select(n.cast("string").alias("id"), F.lit(PATCH).alias("patch"), F.col("p_name").alias("name"), F.when(n % 3 == 0, "None").otherwise(F.col("p_type")).alias("partype"), stats.alias("stats"))


def champion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select(n.alias("query_id"), F.lit(PATCH).alias("patch"), F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, F.upper("p_name")).otherwise("nobody").alias("champion"))
    return lookups.champion_ids(asked, _champions(spark, sf_dir)).select("query_id", "id")


def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.stat_line(_champions(spark, sf_dir)).select("id", "line")


def _phrases(spark) -> DataFrame:
    return spark.createDataFrame([("armor penetration", "ArmorPenetration"), ("lethality", None)], "phrase string, tag string")


def list_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.list_passages(lookups.items_with_stat(_items(spark, sf_dir), _phrases(spark))).select("phrase", "content", "heading_path")


def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question through linking, classification and the lookup of its branch."""
    abilities = _abilities(spark, sf_dir).withColumn("description", F.lit(""))
    items = _items(spark, sf_dir).withColumn("stats", F.create_map(F.lit("Gold"), F.col("gold_total").cast("double")))
    return lookups.analyze(_linked(spark, sf_dir), PATCH, _champions(spark, sf_dir), abilities, items).select("query_id", "content", "heading_path")


def _specs(spark, sf_dir) -> DataFrame:
    """A lookup spec for every part: one asks for all items of a phrase, the others in turn for an ability, an item's price or a champion's stat."""
    n = F.col("p_partkey")
    kind = F.when(n == 7, "items_with").when(n % 3 == 0, "ability").when(n % 3 == 1, "item").otherwise("champion")
    field = F.when(kind == "ability", "cooldown").when(kind == "item", "gold_total").otherwise("hp")
    return table(spark, sf_dir, "part").select(n.alias("qid"), F.lit(PATCH).alias("patch"), kind.alias("lookup"), n.cast("string").alias("champion"), F.lit("Q").alias("slot"), field.alias("field"), (F.col("p_size") % 6).cast("int").alias("rank"), F.col("p_name").alias("item"), F.lit("lethality").alias("phrase"), F.lit(None).cast("string").alias("tag"))


def _derived(spark, sf_dir) -> DataFrame:
    return evaluate.derive_labels(_specs(spark, sf_dir), _champions(spark, sf_dir), _abilities(spark, sf_dir), _items(spark, sf_dir).withColumn("stats", F.create_map().cast("map<string,double>")))


def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).select("qid", F.round("value", 4).alias("value"), F.array_join("items", "; ").alias("items"))


def label_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that every part once had, its price and no items, against those that its spec gives now."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.floor("p_retailprice").cast("double").alias("value"), F.lit(None).cast("array<string>").alias("items"))
    return evaluate.label_diff(old, _derived(spark, sf_dir))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace(lower({x}), '''s\\b', '', 'g'), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


def _any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def _words(x: str, needles) -> str:
    return _any(x, [f" {n} " for n in needles])


def _first(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{n}') THEN '{v}'" for n, v in pairs) + " END"


_CANON = f"parts AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, {_norm('p_name')} AS norm, length(p_name) % 2 = 1 AS odd FROM part), canon AS (SELECT *, row_number() OVER (PARTITION BY odd, norm ORDER BY {_norm('id')} <> norm, length(id), id) = 1 AS kept FROM parts)"
_ALIAS = f"""{_CANON}, champs AS (SELECT * FROM canon WHERE kept AND NOT odd),
 raw AS (SELECT CASE id::BIGINT % 5 WHEN 0 THEN left(name, 1) WHEN 1 THEN name ELSE split_part(name, ' ', 1) END AS alias, CASE WHEN id::BIGINT % 5 = 2 THEN 'x' || id ELSE id END AS id, id::BIGINT AS ord FROM parts WHERE NOT odd),
 named AS (SELECT r.*, {_norm('r.alias')} AS k, c.name FROM raw r LEFT JOIN champs c ON c.id = r.id),
 judged AS (SELECT *, CASE WHEN length(k) < 2 THEN 'short' WHEN k IN (SELECT norm FROM champs) THEN 'collision' WHEN name IS NULL THEN 'unknown' END AS reason FROM named),
 good AS (SELECT *, first_value(id) OVER (PARTITION BY k ORDER BY ord) AS owner FROM judged WHERE reason IS NULL),
 kept_alias AS (SELECT k AS alias, id, name, min(ord) AS ord FROM good WHERE id = owner GROUP BY ALL)"""
_DICT = f"""{_ALIAS}, entries AS (SELECT 'champion' AS kind, norm, id AS entity_id, name, 0 AS leg, id AS key FROM champs UNION ALL SELECT 'champion', alias, id, name, 1, lpad(ord::VARCHAR, 12, '0') FROM kept_alias WHERE alias NOT IN (SELECT norm FROM champs)
 UNION ALL SELECT DISTINCT 'item', norm, name, name, 2, name FROM parts WHERE odd), dictionary AS (SELECT kind, norm, entity_id, name, row_number() OVER (PARTITION BY kind ORDER BY leg, key) AS ord FROM entries)"""
_ASKED = """asked AS (SELECT p.p_partkey AS query_id, CASE p.p_partkey % 9 WHEN 0 THEN 'What is the cooldown of ' || p.p_name || '''s Q at rank ' || (p.p_size % 6) || '?' WHEN 1 THEN 'how much does ' || p.p_name || ' cost' WHEN 2 THEN p.p_name || ' base stats'
 WHEN 3 THEN 'which items give lethality and armor penetration? ' || p.p_brand WHEN 4 THEN 'Who wins ' || p.p_name || ' vs ' || coalesce(o.p_name, 'nobody') || ' mid' WHEN 5 THEN 'what jungler is ' || p.p_name || ' good against' WHEN 6 THEN 'what should I build on ' || p.p_name || ' top'
 WHEN 7 THEN 'what lane does ' || p.p_name || ' play, is it popular?' ELSE 'how does ' || p.p_name || ' build up the passive ultimate armor?' END AS query FROM part p LEFT JOIN part o ON o.p_partkey = p.p_partkey + 1)"""
_LINKS = f"""{_DICT}, {_ASKED}, n AS (SELECT *, ' ' || {_norm('query')} || ' ' AS q FROM asked),
 links AS (SELECT query_id, kind, entity_id, arg_min(name, ord) AS name, min(ord) AS ord FROM n JOIN dictionary d ON d.norm <> '' AND (contains(q, ' ' || d.norm || ' ') OR contains(q, ' ' || d.norm || 's ')) GROUP BY ALL),
 said AS (SELECT a.query_id, a.query, lower(a.query) AS l, ' ' || lower(a.query) || ' ' AS p, ' ' || {_norm('a.query')} || ' ' AS w, (SELECT list(name ORDER BY ord) FROM links k WHERE k.query_id = a.query_id AND kind = 'champion') AS ch, (SELECT list(entity_id ORDER BY ord) FROM links k WHERE k.query_id = a.query_id AND kind = 'champion') AS ci, (SELECT list(name ORDER BY ord) FROM links k WHERE k.query_id = a.query_id AND kind = 'item') AS it, (SELECT count(*) FROM links k WHERE k.query_id = a.query_id AND kind = 'item') AS n_items FROM asked a),
 f AS (SELECT *, coalesce(len(ch), 0) AS n_ch, CASE WHEN contains(l, 'passive') THEN 'P' WHEN regexp_matches(l, '\\bult(imate|i)?\\b') THEN 'R' ELSE nullif(regexp_extract(query, '\\b([QWER])\\b', 1), '') END AS slot,
 try_cast(nullif(regexp_extract(query, '(?i)\\b(?:rank|level|lvl)\\s*(\\d+)', 1), '') AS BIGINT) AS rank, {_first('l', [(x, x) for x in sorted(intents.STAT_PHRASES, key=len, reverse=True)])} AS phrase, {_first('l', intents.BASE_STATS)} AS field FROM said),
 g AS (SELECT *, rank IS NOT NULL OR {_any('l', intents.NUMERIC_WORDS)} AS numeric, {_any('p', intents.MATCHUP_WORDS)} AS mu, {_any('p', intents.ROLE_WORDS)} AS ro, NOT {_any('p', intents.BUILD_VERBS)} AND {_words('w', intents.BUILD_WORDS)} AS bu FROM f),
 h AS (SELECT *, CASE WHEN n_ch >= 2 AND mu THEN 'matchup' WHEN n_ch = 1 AND mu THEN 'counters' WHEN n_ch >= 1 AND bu THEN 'build' WHEN n_ch >= 1 AND (ro OR {_any('p', intents.POPULARITY_WORDS)}) THEN 'champion_stats' END AS kind FROM g)"""
_STAT = "CASE p_size % 3 WHEN 0 THEN p_size || '% Armor Penetration' WHEN 1 THEN p_size || ' Lethality' ELSE '10 Armor' END"
_LETHAL = "CASE WHEN regexp_matches(description, '(?i)\\d\\s*%?\\s*lethality\\b') THEN replace(regexp_extract(description, '(?i)(\\d+(?:\\.\\d+)?\\s*%?)\\s*lethality\\b', 1), ' ', '') || ' lethality' END"
_BRANCH = f"CASE WHEN n_ch > 0 AND slot IN ('Q', 'W', 'E', 'R') AND numeric THEN 'ability' WHEN n_ch > 0 AND slot IS NULL AND (field IS NOT NULL OR {_words('w', intents.FULL_STATS)}) THEN 'champion_stat' WHEN n_items = 0 AND n_ch = 0 AND phrase IS NOT NULL AND {_any('l', ('item', 'which'))} THEN 'items_with' WHEN n_items > 0 AND numeric THEN 'item' END"


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE ({x})::DOUBLE::VARCHAR END"


_CHAMPS = """cs AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE p_type END AS partype, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 500.0::DOUBLE END AS hp, p_partkey % 7 + 0.5::DOUBLE AS hpl,
 CASE WHEN p_partkey % 2 = 0 THEN p_size * 10.0::DOUBLE ELSE 0.0 END AS mp, p_size / 2.0::DOUBLE AS armor FROM part WHERE length(p_name) % 2 = 0),"""
_LINE = f"""{_CHAMPS} cl AS (SELECT *, concat_ws('; ', CASE WHEN hp IS NOT NULL THEN 'health ' || {_num('hp')} || ' (+' || {_num('hpl')} || '/lvl)' END, CASE WHEN partype <> 'None' AND mp <> 0 THEN lower(trim(partype)) || ' ' || {_num('mp')} END, 'armor ' || {_num('armor')}, 'movement speed 330') || '.'
 || CASE WHEN partype = 'None' THEN ' No mana or secondary resource.' ELSE ' Resource: ' || trim(partype) || '.' END AS line FROM cs)"""
_PLACED = f"""its AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS plaintext, floor(p_retailprice)::BIGINT AS gold_total, {_STAT} AS description, p_type = 'ECONOMY' AS tagged FROM part),
 listed AS (SELECT 'armor penetration' AS phrase, * FROM its WHERE tagged OR contains(lower(description), 'armor penetration') UNION ALL SELECT 'lethality', * FROM its WHERE contains(lower(description), 'lethality')),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase, name ORDER BY gold_total DESC, id DESC) AS k FROM listed) WHERE k = 1),
 placed AS (SELECT *, CASE WHEN phrase <> 'lethality' AND contains(description, 'Armor Penetration') THEN replace(regexp_extract(description, '(\\d+\\s*%?)', 1), ' ', '') || ' armor penetration' ELSE {_LETHAL} END AS value FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY gold_total DESC, name) AS place, count(*) OVER (PARTITION BY phrase) AS total FROM best) WHERE place <= 30),
 lp AS (SELECT phrase, string_agg(name || ' (' || gold_total || 'g, ' || coalesce(value, plaintext) || ')', '; ' ORDER BY place) AS r, count(*) AS n, max(total) AS total FROM placed GROUP BY 1),
 lists AS (SELECT phrase, 'Items with ' || phrase || ' (patch {PATCH}): ' || r || '.' || CASE WHEN total > n THEN ' Showing the ' || n || ' most expensive of ' || total || ' items with ' || phrase || '.' ELSE ' That is all ' || total || ' items with ' || phrase || ' at this patch.' END
  || CASE WHEN phrase = 'armor penetration' AND contains(r, 'lethality') THEN '{lookups.GROUPED_NOTE}' ELSE '' END AS content, 'Items > with ' || phrase AS heading_path FROM lp)"""
_LABEL = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.LABELS.items()) + " ELSE field END"
_VALUE = "CASE field WHEN 'hp' THEN hp WHEN 'mp' THEN mp WHEN 'armor' THEN armor WHEN 'movespeed' THEN 330.0::DOUBLE END"
_BURN = lambda k: f"(SELECT string_agg({_num(f'p_retailprice * {k}.0::DOUBLE / i')}, '/' ORDER BY i) FROM range(1, p_size % 4 + 2) t(i))"
_AT = lambda k: _num(f"p_retailprice * {k}.0::DOUBLE / rank")
SQL = {
    "canonical_names": f"WITH x AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, {_norm('p_name')} AS norm FROM part) SELECT id, name, row_number() OVER (PARTITION BY norm ORDER BY {_norm('id')} <> norm, length(id), id) = 1 AS kept FROM x",
    "latest_version": "WITH x AS (SELECT p_brand AS corpus, '16.' || p_size || '.' || (p_partkey % 3) AS patch, p_size, p_partkey % 3 AS m FROM part) SELECT corpus, first(patch ORDER BY p_size DESC, m DESC) AS latest, max(patch) AS latest_text FROM x GROUP BY 1",
    "roster_aliases": f"WITH {_ALIAS} SELECT alias, id, 'kept' AS reason FROM kept_alias UNION ALL SELECT alias, id, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT alias, id, 'conflict' FROM good WHERE id <> owner",
    "dictionary": f"WITH {_DICT} SELECT * FROM dictionary",
    "entity_links": f"WITH {_LINKS} SELECT * FROM links",
    "branch_decision": f"WITH {_LINKS} SELECT query_id, slot, rank, numeric, phrase, field, {_BRANCH} AS branch FROM g",
    "champion_lookup": "WITH c AS (SELECT p_partkey::VARCHAR AS id, lower(p_name) AS name FROM part WHERE length(p_name) % 2 = 0), n AS (SELECT name, min(id) AS id FROM c GROUP BY 1) SELECT p_partkey AS query_id, coalesce(c.id, n.id) AS id FROM part LEFT JOIN c ON p_partkey % 3 = 0 AND c.id = p_partkey::VARCHAR LEFT JOIN n ON p_partkey % 3 = 1 AND n.name = lower(p_name)",
    "stat_lines": f"WITH {_LINE} SELECT id, line FROM cl",
    "list_passages": f"WITH {_PLACED} SELECT * FROM lists",
    "structured_answers": f"""WITH {_LINKS}, {_LINE}, {_PLACED}, bq AS (SELECT *, {_BRANCH} AS branch FROM g),
 kept AS (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY {_norm('p_partkey::VARCHAR')} <> {_norm('p_name')}, length(p_partkey::VARCHAR), p_partkey::VARCHAR) AS k FROM part)
 SELECT query_id, ch[1] || ' — ' || p_name || ' (Q) [structured stats, patch {PATCH}]. Cooldown per rank: ' || {_BURN(1)} || ' s. Cost per rank: ' || {_BURN(2)} || '. Range per rank: ' || {_BURN(3)} || '.' || CASE WHEN rank BETWEEN 1 AND p_size % 4 + 1 THEN ' At rank ' || rank || ': cooldown ' || {_AT(1)} || ' s, cost ' || {_AT(2)} || ', range ' || {_AT(3)} || '.' ELSE '' END AS content, ch[1] || ' > ' || p_name || ' (Q) — stats' AS heading_path
 FROM bq JOIN part ON p_partkey::VARCHAR = ci[1] WHERE branch = 'ability' AND slot = 'Q'
 UNION ALL SELECT query_id, CASE WHEN v IS NOT NULL THEN name || ' — base ' || label || ': ' || {_num('v')} || ' (patch {PATCH}) [structured base stat]. Other base stats: ' || concat_ws(', ', CASE WHEN field <> 'hp' THEN 'health ' || {_num('hp')} END, CASE WHEN field <> 'armor' THEN 'armor ' || {_num('armor')} END, CASE WHEN field <> 'movespeed' THEN 'movement speed 330' END) || '.' ELSE name || ' — base stats at level 1 (patch {PATCH}) [structured base stats]. ' || line END, name || ' > base stats' || CASE WHEN v IS NOT NULL THEN ' — ' || label ELSE '' END
 FROM (SELECT query_id, field, cl.*, {_VALUE} AS v, {_LABEL} AS label FROM bq JOIN cl ON cl.id = ci[1] WHERE branch = 'champion_stat')
 UNION ALL SELECT query_id, p_name || ' — ' || floor(p_retailprice)::BIGINT || ' gold. ' || p_brand || '. Stats: Gold=' || floor(p_retailprice)::BIGINT || '. ' || {_STAT}, 'Items > ' || p_name || ' — stats' FROM bq JOIN kept ON k = 1 AND lower(p_name) = lower(it[1]) WHERE branch = 'item'
 UNION ALL SELECT query_id, content, heading_path FROM bq JOIN lists USING (phrase) WHERE branch = 'items_with'""",
    "derived_labels": f"""WITH {_CHAMPS} x AS (SELECT 1), k AS (SELECT p_name, floor(p_retailprice)::DOUBLE AS gold, row_number() OVER (PARTITION BY lower(p_name) ORDER BY {_norm('p_partkey::VARCHAR')} <> {_norm('p_name')}, length(p_partkey::VARCHAR), p_partkey::VARCHAR) AS k FROM part),
 l AS (SELECT string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names FROM part WHERE p_size % 3 = 1)
 SELECT p_partkey AS qid, round(CASE WHEN p_partkey = 7 THEN NULL WHEN p_partkey % 3 = 0 THEN CASE WHEN cs.id IS NOT NULL AND p_size % 6 BETWEEN 1 AND p_size % 4 + 1 THEN p_retailprice / (p_size % 6) END WHEN p_partkey % 3 = 1 THEN k.gold ELSE cs.hp END, 4) AS value, CASE WHEN p_partkey = 7 THEN names END AS items FROM part LEFT JOIN cs ON cs.id = p_partkey::VARCHAR LEFT JOIN k ON k.k = 1 AND lower(k.p_name) = lower(part.p_name), l""",
    "label_refresh": f"""WITH {_CHAMPS} x AS (SELECT 1), k AS (SELECT p_name, floor(p_retailprice)::DOUBLE AS gold, row_number() OVER (PARTITION BY lower(p_name) ORDER BY {_norm('p_partkey::VARCHAR')} <> {_norm('p_name')}, length(p_partkey::VARCHAR), p_partkey::VARCHAR) AS k FROM part),
 v AS (SELECT p_partkey AS qid, floor(p_retailprice)::DOUBLE AS old, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN cs.id IS NOT NULL AND p_size % 6 BETWEEN 1 AND p_size % 4 + 1 THEN p_retailprice / (p_size % 6) END WHEN p_partkey % 3 = 1 THEN k.gold ELSE cs.hp END AS new FROM part LEFT JOIN cs ON cs.id = p_partkey::VARCHAR LEFT JOIN k ON k.k = 1 AND lower(k.p_name) = lower(part.p_name))
 SELECT qid, CASE WHEN qid <> 7 AND new IS NULL THEN 'dead' ELSE 'changed' END AS status FROM v WHERE qid = 7 OR new IS DISTINCT FROM old""",
    "intents_by_query": f"WITH {_LINKS} SELECT query_id, kind, CASE WHEN kind IS NOT NULL THEN ch[1] END AS a, CASE WHEN kind = 'matchup' THEN ch[2] END AS b, CASE WHEN kind IS NOT NULL THEN {_first('p', [(f' {t} ', v) for t, v in intents.LANES])} END AS position, CASE WHEN kind = 'counters' THEN CASE WHEN {_any('p', intents.STRONG_WORDS)} THEN 'strong' ELSE 'weak' END END AS direction, CASE WHEN kind = 'champion_stats' THEN ro END AS role_query FROM h",
    "ability_rank_value": "WITH r AS (SELECT unnest(range(0, 4)) AS rank), a AS (SELECT s_suppkey, rank, s_suppkey % 10 <> 0 AS has FROM supplier, r) SELECT s_suppkey || '-' || rank AS query_id, CASE WHEN has THEN p_name END AS name, CASE WHEN has AND rank BETWEEN 1 AND p_size % 4 + 1 THEN round(p_retailprice / rank, 4) END AS cooldown, CASE WHEN has AND rank BETWEEN 1 AND p_size % 4 + 1 THEN round(p_retailprice * 2.0::DOUBLE / rank, 4) END AS cost, CASE WHEN has AND rank BETWEEN 1 AND p_size % 4 + 1 THEN round(p_retailprice * 3.0::DOUBLE / rank, 4) END AS range FROM a LEFT JOIN part ON p_partkey = s_suppkey",
    "item_lookup": f"WITH x AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, floor(p_retailprice)::BIGINT AS gold_total, row_number() OVER (PARTITION BY {_norm('p_name')} ORDER BY length(p_partkey::VARCHAR), p_partkey::VARCHAR) = 1 AS kept FROM part) SELECT p_partkey AS query_id, x.id, x.name, x.gold_total FROM part LEFT JOIN x ON kept AND lower(x.name) = CASE WHEN p_partkey % 7 = 0 THEN 'no such thing' ELSE lower(p_name) END",
    "items_with_stat": f"""WITH items AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, floor(p_retailprice)::BIGINT AS gold_total, {_STAT} AS description, p_type = 'ECONOMY' AS tagged FROM part),
 listed AS (SELECT 'armor penetration' AS phrase, * FROM items WHERE tagged OR contains(lower(description), 'armor penetration') UNION ALL SELECT 'lethality', * FROM items WHERE contains(lower(description), 'lethality')),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase, name ORDER BY gold_total DESC, id DESC) AS k FROM listed) WHERE k = 1),
 placed AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY gold_total DESC, name) AS place, count(*) OVER (PARTITION BY phrase) AS total FROM best)
 SELECT phrase, name, gold_total, CASE WHEN phrase <> 'lethality' AND contains(description, 'Armor Penetration') THEN replace(regexp_extract(description, '(\\d+\\s*%?)', 1), ' ', '') || ' armor penetration' ELSE {_LETHAL} END AS value, place, total FROM placed WHERE place <= 30""",
}
QUERIES = {name: globals()[name] for name in SQL}
