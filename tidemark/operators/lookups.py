"""Structured lookups on the typed game tables and their passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.roster import canonical

LIST_LIMIT, MOST_PHRASES = 30, 1_000
#: A stat whose items may state it in another word, and the tags of stats.
SYNONYMS = {"armor penetration": ("armor penetration", "lethality")}
STAT_TAGS = {"armor penetration": "ArmorPenetration", "magic penetration": "MagicPenetration", "ability power": "SpellDamage", "attack damage": "Damage", "attack speed": "AttackSpeed", "critical strike": "CriticalStrike", "ability haste": "AbilityHaste", "cooldown reduction": "CooldownReduction", "life steal": "LifeSteal", "lifesteal": "LifeSteal", "tenacity": "Tenacity", "mana regen": "ManaRegen", "health regen": "HealthRegen"}
#: The stat line in reading order: field, label, growth field.
STAT_LINE = (("hp", "health", "hpperlevel"), ("hpregen", "health regen", "hpregenperlevel"), ("mp", "resource", "mpperlevel"), ("mpregen", "resource regen", "mpregenperlevel"), ("armor", "armor", "armorperlevel"), ("spellblock", "magic resist", "spellblockperlevel"), ("attackdamage", "attack damage", "attackdamageperlevel"), ("attackspeed", "attack speed", "attackspeedperlevel"), ("attackrange", "attack range", None), ("movespeed", "movement speed", None))


def champion_ids(asked: DataFrame, champions: DataFrame) -> DataFrame:
    """`asked` (query_id, patch, champion) with id: the champion of that id, else the least id of that name in any case.

    A name is one row before it meets what is asked, so the rows stay those of `asked`, however many champions share a name.
    """
    ids = champions.select("patch", F.col("id").alias("champion"), F.col("id").alias("__id")).distinct()
    names = champions.groupBy("patch", F.lower("name").alias("__name")).agg(F.min("id").alias("__named"))
    met = asked.withColumn("__name", F.lower("champion")).join(ids, ["patch", "champion"], "left").join(names, ["patch", "__name"], "left")
    return met.select(*asked.columns, F.coalesce("__id", "__named").alias("id"))


def at_rank(values: Column, rank: Column) -> Column:
    """Value of a 1-based rank, null outside."""
    return F.when((rank >= 1) & (rank <= F.size(values)), F.try_element_at(values, F.greatest(rank, F.lit(1))))


def ability_values(asked: DataFrame, abilities: DataFrame) -> DataFrame:
    """`asked` (query_id, champion_id, slot, patch, rank) with the ability's name, cooldown, cost and range at that rank."""
    met = asked.join(abilities, ["champion_id", "slot", "patch"], "left")
    return met.select(*asked.columns, "name", *(at_rank(F.col(c), F.col("rank")).alias(c) for c in ("cooldown", "cost", "range")))


def item_by_name(asked: DataFrame, items: DataFrame) -> DataFrame:
    """`asked` (query_id, patch, item) with the canonical item of that name in any case; null where there is none."""
    kept = canonical(items).filter("kept").drop("kept").withColumn("__name", F.lower("name"))
    return asked.withColumn("__name", F.lower("item")).join(kept, ["patch", "__name"], "left").drop("__name")


def stat_value(description: Column, phrase: str) -> Column:
    """'18% armor penetration' of a description, trying the phrase's synonyms in order; null if none is stated."""
    out = F.lit(None).cast("string")
    for term in reversed(SYNONYMS.get(phrase, (phrase,))):
        found = F.regexp_extract(description, rf"(?i)(\d+(?:\.\d+)?\s*%?)\s*{term}\b", 1)
        out = F.when(found != "", F.concat(F.replace(found, F.lit(" "), F.lit("")), F.lit(f" {term}"))).otherwise(out)
    return out


def with_stat(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """`items` that have the tag or the words of a phrase, with phrase, for each of `phrases` (phrase, tag): the fixed vocabulary of stats. More than MOST_PHRASES are an error, as every item meets every phrase."""
    if phrases.limit(MOST_PHRASES + 1).count() > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    text = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("plaintext", F.lit(""))))
    fits = F.contains(F.col("__text"), F.lower(F.col("phrase"))) | F.coalesce(F.array_contains("tags", F.col("tag")), F.lit(False))
    return items.withColumn("__text", text).join(F.broadcast(phrases), fits).drop("__text", "tag")


def items_with_stat(items: DataFrame, phrases: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(phrase, patch, name, gold_total, description, plaintext, place, total): items `with_stat`, one row a name, dearest first, cut at `limit` with the whole number in total."""
    row = F.struct("gold_total", "description", "plaintext", "id")
    best = with_stat(items, phrases).groupBy("phrase", "patch", "name").agg(F.max_by(row, F.struct(F.coalesce("gold_total", F.lit(-1)), F.col("id"))).alias("r"))
    flat = best.select("phrase", "patch", "name", "r.gold_total", "r.description", "r.plaintext")
    by = Window.partitionBy("phrase", "patch")
    total = flat.groupBy("phrase", "patch").agg(F.count("*").alias("total"))
    placed = flat.withColumn("place", F.row_number().over(by.orderBy(F.desc_nulls_last("gold_total"), "name"))).filter(F.col("place") <= limit)
    return placed.join(total, ["phrase", "patch"])


# The wording of passages, which questions are answered from.
SHOWN_NOTE, ALL_NOTE = " Showing the %d most expensive of %d items with %s.", " That is all %d items with %s at this patch."
GROUPED_NOTE = (
    " Riot groups all of these under one armor-penetration tag: a percentage value is percent armor penetration and a lethality value is flat armor penetration. "
    "Every item listed here provides armor penetration."
)
LABELS = {"movespeed": "movement speed", "attackrange": "attack range", "attackdamage": "attack damage", "armor": "armor", "spellblock": "magic resist", "hp": "health", "mp": "mana", "attackspeed": "attack speed", "hpregen": "health regen", "mpregen": "mana regen", "crit": "critical strike"}
SHOWN_BESIDE = ("hp", "armor", "attackdamage", "movespeed")


def _stat_in(description: Column, phrase: Column) -> Column:
    """`stat_value` for a phrase of each row: with its synonyms if it has some, else with its own words."""
    own = F.call_function("regexp_extract", description, F.concat(F.lit(r"(?i)(\d+(?:\.\d+)?\s*%?)\s*\Q"), phrase, F.lit(r"\E\b")), F.lit(1))
    out = F.when(own != "", F.concat(F.replace(own, F.lit(" "), F.lit("")), F.lit(" "), phrase))
    for known in SYNONYMS:
        out = F.when(phrase == known, stat_value(description, known)).otherwise(out)
    return out


def list_passages(found: DataFrame) -> DataFrame:
    """One passage (phrase, patch, content, heading_path) for each phrase and patch of `items_with_stat`; a cut list says so."""
    gold = F.when(F.coalesce("gold_total", F.lit(0)) != 0, F.concat(F.col("gold_total").cast("string"), F.lit("g")))
    detail = F.concat_ws(", ", gold, F.coalesce(_stat_in(F.coalesce("description", F.lit("")), F.col("phrase")), F.nullif(F.trim("plaintext"), F.lit(""))))
    piece = F.when(detail != "", F.concat("name", F.lit(" ("), detail, F.lit(")"))).otherwise(F.col("name"))
    rows = found.groupBy("phrase", "patch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("p")))), lambda x: x["p"]), "; ").alias("rows"), F.count("*").alias("n"), F.max("total").alias("total"))
    note = F.when(F.col("total") > F.col("n"), F.format_string(SHOWN_NOTE, "n", "total", "phrase")).otherwise(F.format_string(ALL_NOTE, "total", "phrase"))
    grouped = F.when(F.col("phrase").isin(*SYNONYMS) & F.contains("rows", F.lit("lethality")), GROUPED_NOTE).otherwise("")
    content = F.concat(F.format_string("Items with %s (patch %s): %s.", "phrase", "patch", "rows"), note, grouped)
    return rows.select("phrase", "patch", content.alias("content"), F.concat(F.lit("Items > with "), "phrase").alias("heading_path"))


def _burn(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.transform(values, _number), "/")).otherwise("?")


def ability_passages(asked: DataFrame, abilities: DataFrame) -> DataFrame:
    """(query_id, content, heading_path) of asked (query_id, champion_id, champion, slot, patch, rank); nothing where there is no such ability. A rank outside the ability's is left out."""
    met = asked.join(abilities, ["champion_id", "slot", "patch"])
    at = lambda c: F.coalesce(_number(at_rank(F.col(c), F.col("rank"))), F.lit("?"))
    ranked = F.when(at_rank(F.col("cooldown"), F.col("rank")).isNotNull(), F.concat(F.lit("At rank "), F.col("rank").cast("string"), F.lit(": cooldown "), at("cooldown"), F.lit(" s, cost "), at("cost"), F.lit(", range "), at("range"), F.lit(".")))
    named = F.concat("name", F.lit(" ("), "slot", F.lit(")"))
    lines = (F.concat("champion", F.lit(" — "), named, F.lit(" [structured stats, patch "), "patch", F.lit("].")), *(F.concat(F.lit(f"{label} per rank: "), _burn(F.col(c)), F.lit(end)) for label, c, end in (("Cooldown", "cooldown", " s."), ("Cost", "cost", "."), ("Range", "range", "."))), ranked, F.nullif("description", F.lit("")))
    return met.select("query_id", F.concat_ws(" ", *lines).alias("content"), F.concat("champion", F.lit(" > "), named, F.lit(" — stats")).alias("heading_path"))


def champion_passages(asked: DataFrame, champions: DataFrame) -> DataFrame:
    """(query_id, content, heading_path) of asked (query_id, id, patch, field): the one stat that is named, if the champion has it, else the whole line of stats."""
    lines = stat_line(champions).select("id", "patch", "name", "line")
    met = asked.join(champions.select("id", "patch", "stats"), ["id", "patch"]).join(lines, ["id", "patch"]).filter(F.size("stats") > 0)
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    value, label = F.try_element_at("stats", F.col("field")), F.coalesce(F.try_element_at(labels, F.col("field")), F.col("field"))
    beside = F.concat_ws(", ", *(F.when(F.col("field") != f, F.concat(F.lit(f"{LABELS[f]} "), _number(F.try_element_at("stats", F.lit(f))))) for f in SHOWN_BESIDE))
    one = F.concat("name", F.lit(" — base "), label, F.lit(": "), _number(value), F.lit(" (patch "), "patch", F.lit(") [structured base stat]. Other base stats: "), beside, F.lit("."))
    whole = F.concat("name", F.lit(" — base stats at level 1 (patch "), "patch", F.lit(") [structured base stats]. "), "line")
    return met.select("query_id", F.when(value.isNotNull(), one).otherwise(whole).alias("content"), F.concat("name", F.lit(" > base stats"), F.when(value.isNotNull(), F.concat(F.lit(" — "), label)).otherwise("")).alias("heading_path"))


def item_passages(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, content, heading_path) of asked (query_id, patch, item)."""
    met = item_by_name(asked, items).filter("name is not null")
    stats = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("stats", F.create_map().cast("map<string,double>")))), lambda e: F.concat(e["key"], F.lit("="), _number(e["value"]))), ", ")
    content = F.concat("name", F.lit(" — "), F.coalesce(F.col("gold_total").cast("string"), F.lit("None")), F.lit(" gold. "), F.coalesce("plaintext", F.lit("")), F.lit(". Stats: "), F.coalesce(F.nullif(stats, F.lit("")), F.lit("n/a")), F.lit(". "), F.coalesce("description", F.lit("")))
    return met.select("query_id", content.alias("content"), F.concat(F.lit("Items > "), "name", F.lit(" — stats")).alias("heading_path"))


def analyze(classified: DataFrame, patch: str, champions: DataFrame, abilities: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, ord, content, heading_path): the passage that each structured question is answered from, by its branch. `classified` is the result of `intents.classify`; questions without a branch or a hit give none. They are linked and classified once for all branches."""
    kept = classified.filter("branch is not null").select("query_id", "branch", "slot", "rank", "phrase", "field", "items", F.try_element_at("champions", F.lit(1)).alias("__one"))
    asked = cut(kept).withColumn("patch", F.lit(patch))
    of = lambda branch: asked.filter(F.col("branch") == branch)
    ability = ability_passages(of("ability").select("query_id", F.col("__one.id").alias("champion_id"), F.col("__one.name").alias("champion"), "slot", "patch", "rank"), abilities)
    champion = champion_passages(of("champion_stat").select("query_id", F.col("__one.id").alias("id"), "patch", "field"), champions)
    item = item_passages(of("item").select("query_id", "patch", F.try_element_at("items", F.lit(1)).alias("item")), items)
    tags = F.create_map(*(F.lit(x) for pair in STAT_TAGS.items() for x in pair))
    listed = of("items_with").select("query_id", "phrase", "patch")
    phrases = listed.select("phrase").distinct().withColumn("tag", F.try_element_at(tags, F.col("phrase")))
    lists = listed.join(list_passages(items_with_stat(items.filter(F.col("patch") == patch), phrases)), ["phrase", "patch"]).select("query_id", "content", "heading_path")
    return ability.unionByName(champion).unionByName(item).unionByName(lists).select("query_id", F.lit(0).alias("ord"), "content", "heading_path")


def stat_line(champions: DataFrame) -> DataFrame:
    """(id, patch, name, line) from champions with a stats map: every stat in order with its growth; resource rows only with a resource and a value."""
    resource = F.lower(F.trim(F.coalesce("partype", F.lit(""))))
    without = resource.isin("", "none", "manaless")
    parts = []
    for field, label, growth in STAT_LINE:
        value = F.try_element_at("stats", F.lit(field))
        named = F.replace(F.lit(label), F.lit("resource"), resource) if field in ("mp", "mpregen") else F.lit(label)
        more = F.try_element_at("stats", F.lit(growth)) if growth else F.lit(None).cast("double")
        piece = F.concat(named, F.lit(" "), _number(value), F.when(F.coalesce(more, F.lit(0.0)) != 0, F.concat(F.lit(" (+"), _number(more), F.lit("/lvl)"))).otherwise(""))
        shown = value.isNotNull() & (~without & (value != 0) if field in ("mp", "mpregen") else F.lit(True))
        parts.append(F.when(shown, piece))
    note = F.when(without, " No mana or secondary resource.").otherwise(F.concat(F.lit(" Resource: "), F.trim("partype"), F.lit(".")))
    return champions.select("id", "patch", "name", F.concat(F.array_join(F.array_compact(F.array(*parts)), "; "), F.lit("."), note).alias("line"))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
