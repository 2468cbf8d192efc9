"""Typed tables and prose chunks from nested game JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_markup

MAP = "11"


def _entries(raw: DataFrame) -> DataFrame:
    """Entries of `data`. A plain explode would have Spark ask for the size of `data` too, by a filter that parses every document twice more, before documents are dealt to tasks."""
    return raw.select(F.explode_outer("data").alias("id", "r")).filter("id is not null")


def champions(raw: DataFrame, patch: str) -> DataFrame:
    r = _entries(raw)
    empty = F.coalesce("r.tags", F.array().cast("array<string>"))
    return r.select("id", F.lit(patch).alias("patch"), "r.name", "r.title", empty.alias("tags"), "r.partype", F.coalesce("r.stats", F.create_map().cast("map<string,double>")).alias("stats"))


def _spells(raw: DataFrame) -> DataFrame:
    letters = F.array(*map(F.lit, "QWER"))
    zipped = F.arrays_zip(letters.alias("slot"), F.slice("r.spells", 1, 4).alias("spell"))
    return _entries(raw).select("id", F.col("r.name").alias("champion"), F.explode(zipped).alias("z")).select("id", "champion", F.col("z.slot").alias("slot"), F.col("z.spell").alias("s")).filter("s is not null")


def abilities(raw: DataFrame, patch: str) -> DataFrame:
    """One row for each of a champion's first four spells; the passive has none."""
    return _spells(raw).select(F.col("id").alias("champion_id"), F.lit(patch).alias("patch"), "slot", "s.name", strip_markup(F.col("s.description")).alias("description"), "s.cooldown", "s.cost", "s.range", F.col("s.maxrank").alias("max_rank"))


def _prose(content: Column, heading: Column) -> list[Column]:
    return [F.trim(content).alias("content"), heading.alias("heading_path")]


def champion_prose(raw: DataFrame) -> DataFrame:
    """(content, heading_path) of passives that say something and of abilities with their numbers."""
    p = _entries(raw).select(F.col("r.name").alias("c"), F.coalesce("r.passive.name", F.lit("")).alias("n"), strip_markup(F.col("r.passive.description")).alias("d")).filter("d <> ''")
    passive = p.select(*_prose(F.concat("c", F.lit(" — Passive: "), "n", F.lit(". "), "d"), F.concat("c", F.lit(" > Passive: "), "n")))
    burn = lambda f: F.coalesce(f"s.{f}", F.lit("?"))
    numbers = F.concat(F.lit("Cooldown "), burn("cooldownBurn"), F.lit("s · cost "), burn("costBurn"), F.lit(" · range "), burn("rangeBurn"), F.lit("."))
    name = F.coalesce("s.name", F.lit(""))
    spell = _spells(raw).select(*_prose(F.concat("champion", F.lit(" — "), name, F.lit(" ("), "slot", F.lit("). "), strip_markup(F.col("s.description")), F.lit(" "), numbers), F.concat("champion", F.lit(" > "), name, F.lit(" ("), "slot", F.lit(")"))))
    return passive.unionByName(spell)


def items(raw: DataFrame, patch: str) -> DataFrame:
    """Items that have a name and a price and are sold on the main map."""
    sold = _entries(raw).filter((F.coalesce("r.name", F.lit("")) != "") & (F.coalesce("r.gold.total", F.lit(0)) > 0) & F.coalesce(F.try_element_at("r.maps", F.lit(MAP)), F.lit(False)))
    return sold.select("id", F.lit(patch).alias("patch"), "r.name", "r.plaintext", strip_markup(F.col("r.description")).alias("description"), F.col("r.gold.total").alias("gold_total"), F.col("r.gold.base").alias("gold_base"), F.coalesce("r.stats", F.create_map().cast("map<string,double>")).alias("stats"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"))


def item_prose(rows: DataFrame) -> DataFrame:
    return rows.select(*_prose(F.concat("name", F.lit(" (item, "), F.col("gold_total").cast("string"), F.lit(" gold). "), F.coalesce("plaintext", F.lit("")), F.lit(". "), "description"), F.concat(F.lit("Items > "), "name")))


def rune_prose(raw: DataFrame) -> DataFrame:
    runes = raw.select(F.col("name").alias("tree"), F.explode_outer("slots").alias("s")).filter("s is not null").select("tree", F.explode("s.runes").alias("r"))
    body = strip_markup(F.coalesce(F.nullif(F.col("r.longDesc"), F.lit("")), "r.shortDesc"))
    named = runes.select("tree", F.col("r.name").alias("n"), body.alias("d")).filter("d <> ''")
    return named.select(*_prose(F.concat("n", F.lit(" (rune, "), "tree", F.lit(" tree). "), "d"), F.concat(F.lit("Runes > "), "tree", F.lit(" > "), "n")))


def summoner_prose(raw: DataFrame) -> DataFrame:
    s = _entries(raw).select(F.col("r.name").alias("n"), strip_markup(F.col("r.description")).alias("d"), F.coalesce("r.cooldownBurn", F.lit("?")).alias("c")).filter("d <> ''")
    return s.select(*_prose(F.concat("n", F.lit(" (summoner spell). "), "d", F.lit(" Cooldown "), "c", F.lit("s.")), F.concat(F.lit("Summoner Spells > "), "n")))
