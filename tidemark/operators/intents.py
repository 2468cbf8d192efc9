"""Question classifiers as column expressions on the raw query and the linked entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import has_any, has_word, norm_name, padded

# The vocabulary of the classifiers. Order matters where the first match wins.
NUMERIC_WORDS = ("cooldown", "cd", "cost", "mana", "energy", "damage", "dmg", "range", "gold", "price", "cheap", "how much", "how long", "how far", "how many", "scaling", "base", "stat", "stats", "haste", "penetration", "lethality", "value")
STAT_PHRASES = ("armor penetration", "magic penetration", "ability power", "attack damage", "attack speed", "critical strike", "movement speed", "move speed", "ability haste", "cooldown reduction", "life steal", "lifesteal", "omnivamp", "lethality", "tenacity", "mana regen", "health regen")
BASE_STATS = (
    ("movement speed", "movespeed"), ("move speed", "movespeed"), ("movespeed", "movespeed"), ("attack range", "attackrange"), ("attack damage", "attackdamage"), ("attack speed", "attackspeed"),
    ("magic resistance", "spellblock"), ("magic resist", "spellblock"), ("health regen", "hpregen"), ("mana regen", "mpregen"), ("armor", "armor"), ("health", "hp"), ("hp", "hp"), ("mana", "mp"), ("range", "attackrange"),
)
FULL_STATS = ("base stats", "base stat", "stat line", "statline", "stat block", "stat sheet", "statsheet", "all stats", "full stats", "stats", "stat", "attributes", "base numbers")
MATCHUP_WORDS = ("counter", "counters", "countered", "beat", "beats", "who beats", "who wins", " vs ", " vs.", " versus ", "matchup", "match up", "good into", "bad into", "good against", "bad against", "best against", "wins against", "lose to", "loses to", "struggle against", "strong against", "weak against")
STRONG_WORDS = ("good against", "strong against", "good into", "best against", "wins against")
POPULARITY_WORDS = ("win rate", "winrate", "win-rate", " wr ", "win%", "pick rate", "ban rate", "popular", "popularity", "tier", "meta", "good right now", "how strong", "how good", "for beginners", "beginner", "beginner-friendly", "worth playing", "is it good", "strong right now", "best pick")
ROLE_WORDS = ("role", "what lane", "which lane", "what position", "which position", "lane does", "position does", "played in", "where do you play", "where does he play", "where is he played", "primary role", "main role")
BUILD_WORDS = ("items", "item", "build", "builds", "building", "buy", "buys", "build path", "core items", "best items", "item build", "first item", "runes", "rune", "rune page", "skill order", "skill max", "max order", "what to get", "what do i get")
BUILD_VERBS = (" build up ", " builds up ", " building up ")
LANES = (("top", "top"), ("mid", "mid"), ("middle", "mid"), ("jungle", "jungle"), ("jg", "jungle"), ("jungler", "jungle"), ("adc", "adc"), ("bot", "adc"), ("bottom", "adc"), ("botlane", "adc"), ("support", "support"), ("supp", "support"), ("sup", "support"))

INTENT = "struct<kind:string,a:string,b:string,position:string,direction:string,role_query:boolean>"


def first_of(text: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for needle, value in reversed(tuple(pairs)):
        out = F.when(F.contains(text, F.lit(needle)), F.lit(value)).otherwise(out)
    return out


def ability_slot(query: Column) -> Column:
    q = F.lower(query)
    letter = F.regexp_extract(query, r"\b([QWER])\b", 1)
    return F.when(F.contains(q, F.lit("passive")), "P").when(q.rlike(r"\bult(imate|i)?\b"), "R").when(letter != "", letter)


def rank(query: Column) -> Column:
    return F.regexp_extract(query, r"(?i)\b(?:rank|level|lvl)\s*(\d+)", 1).try_cast("int")


def is_numeric(query: Column) -> Column:
    return F.coalesce(rank(query).isNotNull() | has_any(F.lower(query), NUMERIC_WORDS), F.lit(False))


def stat_phrase(query: Column) -> Column:
    by_length = sorted(STAT_PHRASES, key=len, reverse=True)
    return first_of(F.lower(query), [(p, p) for p in by_length])


def base_stat(query: Column) -> Column:
    return first_of(F.lower(query), BASE_STATS)


def wants_all_stats(query: Column) -> Column:
    return has_word(padded(norm_name(query)), FULL_STATS)


def wants_build(query: Column) -> Column:
    return ~has_any(padded(F.lower(query)), BUILD_VERBS) & has_word(padded(norm_name(query)), BUILD_WORDS)


def lane(query: Column) -> Column:
    return first_of(padded(F.lower(query)), [(f" {term} ", value) for term, value in LANES])


def branch(query: Column, champions: Column, items: Column) -> Column:
    """The structured lookup that answers a question, or null for prose."""
    q, slot, some = F.lower(query), ability_slot(query), F.size(champions) > 0
    return (
        F.when(some & slot.isin("Q", "W", "E", "R") & is_numeric(query), "ability")
        .when(some & slot.isNull() & (base_stat(query).isNotNull() | wants_all_stats(query)), "champion_stat")
        .when((F.size(items) == 0) & ~some & stat_phrase(query).isNotNull() & has_any(q, ("item", "which")), "items_with")
        .when((F.size(items) > 0) & is_numeric(query), "item")
    )


def statistics(query: Column, champions: Column) -> Column:
    """The statistics question as a struct (kind, a, b, position, direction, role_query), or null."""
    q, n = padded(F.lower(query)), F.size(champions)
    matchup, role = has_any(q, MATCHUP_WORDS), has_any(q, ROLE_WORDS)
    name = lambda i: F.try_element_at(champions, F.lit(i))["name"]
    kind = (
        F.when((n >= 2) & matchup, "matchup").when((n == 1) & matchup, "counters").when((n >= 1) & wants_build(query), "build").when((n >= 1) & (role | has_any(q, POPULARITY_WORDS)), "champion_stats")
    )
    direction = F.when(kind == "counters", F.when(has_any(q, STRONG_WORDS), "strong").otherwise("weak"))
    whole = F.struct(kind.alias("kind"), name(1).alias("a"), F.when(kind == "matchup", name(2)).alias("b"), lane(query).alias("position"), direction.alias("direction"), F.when(kind == "champion_stats", role).alias("role_query"))
    return F.when(kind.isNotNull(), whole)


def classify(linked: DataFrame) -> DataFrame:
    """`linked` (query, champions, items) with slot, rank, numeric, phrase, field, branch and the statistics intent."""
    q = F.col("query")
    return linked.withColumns({"slot": ability_slot(q), "rank": rank(q), "numeric": is_numeric(q), "phrase": stat_phrase(q), "field": base_stat(q), "branch": branch(q, F.col("champions"), F.col("items")), "intent": statistics(q, F.col("champions"))})
