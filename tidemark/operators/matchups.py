"""Match-up statistics: rates, sample floor, sides, pages, head-to-head, lanes and payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, SHOWN = 50, 5
LANES = ("top", "jungle", "mid", "adc", "support")
KEY = ("champion", "lane")


def percent(share: Column) -> Column:
    """A share as a percentage of one decimal; null stays null."""
    return F.round(share * 100, 1)


def rates(matchups: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Rows (champion, lane, row_no, opponent, play, win) that have a name, plays and wins, with my_rate, opp_rate and `counts` (at or above the floor)."""
    good = matchups.filter((F.coalesce(F.trim("opponent"), F.lit("")) != "") & (F.coalesce("play", F.lit(0)) != 0) & F.col("win").isNotNull())
    rated = good.withColumn("my_rate", percent(F.col("win") / F.col("play")))
    return rated.withColumns({"opp_rate": F.round(100 - F.col("my_rate"), 1), "counts": F.col("play") >= floor})


def sides(rated: DataFrame) -> DataFrame:
    """Rows at or above the floor with side (weak below 50, strong above; exactly 50 is neither) and place: weak ascends, strong descends, ties keep the table's order."""
    side = F.when(F.col("my_rate") < 50, "weak").when(F.col("my_rate") > 50, "strong")
    split = rated.filter("counts").withColumn("side", side).filter(F.col("side").isNotNull())
    order = F.when(F.col("side") == "weak", F.col("my_rate")).otherwise(-F.col("my_rate"))
    return split.withColumn("place", F.row_number().over(Window.partitionBy(*KEY, "side").orderBy(order, "row_no")))


def top(rated: DataFrame, n: int = SHOWN) -> DataFrame:
    return sides(rated).filter(F.col("place") <= n)


def _same(name: str) -> Column:
    return F.lower(F.trim(name))


def next_page(rated: DataFrame, seen: DataFrame, n: int = SHOWN) -> DataFrame:
    """The best n of each side without the opponents of `seen` (champion, lane, opponent); case and outer spaces don't count."""
    named = seen.select(*KEY, _same("opponent").alias("__name")).distinct()
    return top(rated.withColumn("__name", _same("opponent")).join(named, [*KEY, "__name"], "left_anti").drop("__name"), n)


def status(rated: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per champion, lane and side: total, below_floor, on_side, left and status (rows, exhausted, under_floor, none_on_side)."""
    totals = rated.groupBy(*KEY).agg(F.count("*").alias("total"), F.count_if(~F.col("counts")).alias("below_floor"))
    both = totals.withColumn("side", F.explode(F.array(F.lit("weak"), F.lit("strong"))))
    here = sides(rated)
    on = here.groupBy(*KEY, "side").agg(F.count("*").alias("on_side"))
    if seen is not None:
        named = seen.select(*KEY, _same("opponent").alias("__name")).distinct()
        here = here.withColumn("__name", _same("opponent")).join(named, [*KEY, "__name"], "left_anti")
    left = here.groupBy(*KEY, "side").agg(F.count("*").alias("left"))
    out = both.join(on, [*KEY, "side"], "left").join(left, [*KEY, "side"], "left").fillna(0, ["on_side", "left"])
    what = F.when(F.col("left") > 0, "rows").when(F.col("on_side") > 0, "exhausted").when(F.col("total") == F.col("below_floor"), "under_floor").otherwise("none_on_side")
    return out.withColumn("status", what)


def head_to_head(rated: DataFrame, asked: DataFrame, floor: int = FLOOR) -> DataFrame:
    """For every (champion, lane, opponent) of `asked`: the row of that very name, else the first row whose name contains it; thin marks samples below the floor, and `found` is false where the caller falls back to the overall rate.

    Names are taken apart into what could be asked for, their substrings of the lengths that are asked for in their lane, and those meet the asked
    names by equality: no asked name is held against every row of a lane. A row stands for all rows of its name. A blank name is part of every name, a null one of none.
    """
    want = asked.select(*KEY, F.col("opponent").alias("asked"), _same("opponent").alias("__want")).distinct()
    first = F.min_by(F.struct("opponent", "my_rate", "play"), "row_no").alias("p")
    names = rated.withColumn("__name", _same("opponent")).groupBy(*KEY, "__name").agg(first, F.min("row_no").alias("__row"))
    lengths = want.groupBy(*KEY).agg(F.collect_set(F.char_length("__want")).alias("__lengths"))
    size = F.char_length("__name")
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring("__name", at, n))
    parts = F.array_distinct(F.flatten(F.transform(F.filter("__lengths", lambda n: n <= size), cut)))
    met = names.join(lengths, [*KEY]).select(*KEY, "__name", "__row", "p", F.explode(parts).alias("__want"))
    best = met.groupBy(*KEY, "__want").agg(F.min_by("p", F.struct((F.col("__name") != F.col("__want")).alias("x"), "__row")).alias("p"))
    out = want.join(best, [*KEY, "__want"], "left")
    return out.select(*KEY, "asked", F.col("p.opponent").alias("opponent"), F.col("p.my_rate").alias("my_rate"), F.col("p.play").alias("play"), F.coalesce(F.col("p.play") < floor, F.lit(False)).alias("thin"), F.col("p").isNotNull().alias("found"))


def primary_lane(positions: DataFrame, fallback: str = "mid") -> DataFrame:
    """(champion, lane, provenance) from (champion, ord, name, role_rate): the valid lane of the highest rate, a missing rate is 0, the first wins ties; without a valid lane the fallback is assumed."""
    lane = F.lower(F.trim("name"))
    valid = positions.withColumn("lane", F.when(lane.isin(*LANES), lane))
    best = F.max_by("lane", F.when(F.col("lane").isNotNull(), F.struct(F.coalesce("role_rate", F.lit(0.0)), -F.col("ord")))).alias("lane")
    out = valid.groupBy("champion").agg(best)
    return out.select("champion", F.coalesce("lane", F.lit(fallback)).alias("lane"), F.when(F.col("lane").isNull(), "assumed").otherwise("discovered").alias("provenance"))


def role_split(positions: DataFrame) -> DataFrame:
    """(champion, lane, share, place): valid lanes by share, greatest first."""
    lane = F.lower(F.trim("name"))
    shares = positions.filter(lane.isin(*LANES)).select("champion", lane.alias("lane"), percent(F.col("role_rate")).alias("share"), "ord")
    return shares.withColumn("place", F.row_number().over(Window.partitionBy("champion").orderBy(F.desc_nulls_last("share"), "ord"))).drop("ord")


def max_order(levels: DataFrame) -> DataFrame:
    """(champion, skills): the first three skills but R in the order of their first point, from (champion, level, skill)."""
    first = levels.groupBy("champion", "skill").agg(F.min("level").alias("level")).filter(F.upper("skill") != "R")
    skills = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("level", "skill"))), lambda x: x["skill"]), 1, 3)
    return first.groupBy("champion").agg(skills.alias("skills"))


def build_groups(builds: DataFrame) -> DataFrame:
    """Build groups (items array<string>, pick_rate, play, win) with only named items, pick percentage and win percentage where there are plays."""
    items = F.filter("items", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return builds.withColumns({"items": items, "pick_rate": percent(F.col("pick_rate")), "win_rate": F.round(F.try_divide(100 * F.col("win"), F.col("play")), 1)})


def averages(analyses: DataFrame) -> DataFrame:
    """`analyses` (data of an analysis payload, ...) with win_rate, pick_rate and ban_rate in percent, tier, rank and play of its summary; what it lacks is null."""
    own = F.col("data.summary.average_stats")
    shares = {c: percent(own[c]) for c in ("win_rate", "pick_rate", "ban_rate")}
    return analyses.withColumns(shares | {c: own[c] for c in ("tier", "rank", "play")}).drop("data")


#: What an analysis must hold for each kind of question.
REQUIRED = {"stats": ("win_rate", "pick_rate", "tier", "rank"), "matchup": ("win_rate",), "role": ("roles",)}


def complete(analyses: DataFrame, kind: str) -> DataFrame:
    """`analyses` with `missing` (the required fields of `kind` that are null, or an empty role list) and `accepted`. Other empty lists are no failure."""
    checks = [F.when(F.col(c).isNull() | (F.size(c) == 0 if c == "roles" else F.lit(False)), c) for c in REQUIRED[kind]]
    return analyses.withColumn("missing", F.array_compact(F.array(*checks))).withColumn("accepted", F.size("missing") == 0)


def counter_rows(counters: DataFrame) -> DataFrame:
    """Counter rows that have a name, plays and wins."""
    return counters.dropna(subset=["opponent", "play", "win"])
