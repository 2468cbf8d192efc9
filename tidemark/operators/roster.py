"""Canonical rows, versions, aliases and the entity dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import norm_name
from tidemark.operators.lineage import cut, numbered

LEAST_ALIAS, SENT_WORDS = 2, 500_000


def canonical(rows: DataFrame) -> DataFrame:
    """`rows` (id, name, patch, ...) with `kept`: of the rows of one display name in a patch, the one whose id is its name, else the shortest, else the least id."""
    named = rows.withColumn("__norm", norm_name(F.col("name")))
    key = F.struct((norm_name(F.col("id")) != F.col("__norm")).alias("x"), F.length("id").alias("n"), F.col("id").alias("id"))
    best = named.groupBy("patch", "__norm").agg(F.min(key).alias("__best"))
    return named.join(best, ["patch", "__norm"]).withColumn("kept", F.col("id") == F.col("__best.id")).drop("__norm", "__best")


def latest_version(rows: DataFrame, by: list[str], lexical: bool = False) -> DataFrame:
    """The latest patch of each group, by its numbers or by its text."""
    key = F.col("patch") if lexical else F.transform(F.split("patch", r"\."), lambda x: x.try_cast("int"))
    return rows.groupBy(*by).agg(F.max_by("patch", key).alias("latest"))


def resolve_aliases(aliases: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, problems) of aliases (alias, id, ord) against a roster (id, name).

    A problem is an alias that is too short, is a real name, names an unknown id, or was given to another id by an earlier good row.
    """
    names = roster.select(norm_name(F.col("name")).alias("__alias"), F.lit(True).alias("__real")).distinct()
    known = roster.select("id", "name").distinct()
    seen = aliases.withColumn("__alias", norm_name(F.col("alias"))).join(names, "__alias", "left").join(known, "id", "left")
    reason = F.when(F.length("__alias") < LEAST_ALIAS, "short").when(F.col("__real"), "collision").when(F.col("name").isNull(), "unknown")
    judged = seen.withColumn("reason", reason)
    good = judged.filter("reason is null")
    first = good.groupBy("__alias").agg(F.min_by("id", "ord").alias("__owner"))
    owned = good.join(first, "__alias").withColumn("reason", F.when(F.col("id") != F.col("__owner"), "conflict"))
    kept = owned.filter("reason is null").groupBy(F.col("__alias").alias("alias"), "id", "name").agg(F.min("ord").alias("ord"))
    problems = judged.filter("reason is not null").select("alias", "id", "reason").unionByName(owned.filter("reason is not null").select("alias", "id", "reason"))
    return kept, problems


def build_dictionary(roster: DataFrame, aliases: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, norm, entity_id, name, ord): kept champions in id order, aliases that add a key, and distinct item names."""
    champions = canonical(roster).filter("kept").select(F.lit("champion").alias("kind"), norm_name(F.col("name")).alias("norm"), F.col("id").alias("entity_id"), "name", F.lit(0).alias("__leg"), F.col("id").alias("__key"))
    kept, _ = resolve_aliases(aliases, champions.select(F.col("entity_id").alias("id"), "name"))
    more = kept.join(champions.select(F.col("norm").alias("alias")), "alias", "left_anti").select(F.lit("champion").alias("kind"), F.col("alias").alias("norm"), F.col("id").alias("entity_id"), "name", F.lit(1).alias("__leg"), F.format_string("%012d", F.col("ord").cast("long")).alias("__key"))
    things = items.select("name").distinct().select(F.lit("item").alias("kind"), norm_name(F.col("name")).alias("norm"), F.col("name").alias("entity_id"), "name", F.lit(2).alias("__leg"), F.col("name").alias("__key"))
    return numbered(champions.unionByName(more).unionByName(things), F.col("__leg"), F.col("__key"), by="kind").drop("__leg", "__key")


def link_entities(queries: DataFrame, dictionary: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, kind, entity_id, name, ord): entities whose normalised name, or that with an s behind, stands as whole words in the text; each once.

    A run of words is looked up only where a key begins with its first word, and no longer than the longest of these keys, and by equality, so no query meets the whole dictionary.
    The table of first words is sent to all tasks if it has at most SENT_WORDS rows.
    """
    keys = dictionary.filter("norm <> ''").withColumn("key", F.explode(F.array(F.col("norm"), F.concat("norm", F.lit("s")))))
    parts = F.split("key", " ")
    firsts = cut(keys.groupBy(parts[0].alias("word")).agg(F.max(F.size(parts)).alias("longest")))
    said = queries.select("query_id", F.split(norm_name(F.col(text)), " ").alias("tokens")).select("query_id", "tokens", F.posexplode("tokens").alias("at", "word"))
    begun = said.join(F.broadcast(firsts) if firsts.count() <= SENT_WORDS else firsts, "word")
    lengths = F.sequence(F.lit(1), F.least("longest", F.size("tokens") - F.col("at")))
    runs = begun.select("query_id", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice("tokens", F.col("at") + 1, n), " "))).alias("key"))
    return runs.join(keys, "key").groupBy("query_id", "kind", "entity_id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def mentions(queries: DataFrame, links: DataFrame) -> DataFrame:
    """`queries` with champions array<struct<id, name>> and items array<string>, in dictionary order."""
    ordered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", F.col("entity_id").alias("id"), "name"))))
    found = links.groupBy("query_id").agg(ordered("champion").alias("__c"), ordered("item").alias("__i"))
    out = queries.join(found, "query_id", "left")
    champions = F.coalesce(F.transform("__c", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))), F.array().cast("array<struct<id:string,name:string>>"))
    items = F.coalesce(F.transform("__i", lambda x: x["name"]), F.array().cast("array<string>"))
    return out.withColumns({"champions": champions, "items": items}).drop("__c", "__i")
