"""Evaluation of retrieval configurations and answers, and label refresh."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tidemark.operators.lineage import cut, numbered
from tidemark.operators.lookups import ability_values, champion_ids, item_by_name, with_stat
from tidemark.operators.search import refusals

KS = (1, 3, 5, 8)
#: Rows of a table of names that is sent to all tasks.
SENT_NAMES = 200_000


def mark_expected(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """`ranked` (qid, source_url, ...) with `right`: whether `expected` (qid, source_url) has the row's url for its question."""
    wanted = expected.select("qid", "source_url").distinct().withColumn("__right", F.lit(True))
    return ranked.join(wanted, ["qid", "source_url"], "left").withColumn("right", F.coalesce("__right", F.lit(False))).drop("__right")


def score_rankings(ranked: DataFrame, questions: DataFrame, configs: list[str]) -> DataFrame:
    """(config, qid, first_rank, hit_1, hit_3, hit_5, hit_8, rr) of every question (qid) in each of `configs`, from rankings (config, qid, rank, right); a miss has no rank, no hits and rr 0."""
    first = ranked.filter("right").groupBy("config", "qid").agg(F.min("rank").alias("first_rank"))
    every = questions.select("qid").distinct().select(F.explode(F.array(*map(F.lit, configs))).alias("config"), "qid")
    out = every.join(first, ["config", "qid"], "left")
    hits = {f"hit_{k}": F.coalesce((F.col("first_rank") <= k).cast("long"), F.lit(0).cast("long")) for k in KS}
    return out.withColumns(hits | {"rr": F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))})


def config_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("config").agg(*(F.avg(f"hit_{k}").alias(f"hit_{k}") for k in KS), F.avg("rr").alias("mrr"), F.count("*").alias("n"))


def best_config(means: DataFrame, order: DataFrame) -> DataFrame:
    """The configuration of the greatest (hit_5, mrr); ties go to the least ord of `order` (config, ord)."""
    return means.join(order, "config").orderBy(F.desc("hit_5"), F.desc("mrr"), "ord").limit(1)


def worst(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n worst questions of each configuration, by rr, then first rank (a miss is 999), then qid."""
    by = Window.partitionBy("config").orderBy("rr", F.coalesce("first_rank", F.lit(999)), "qid")
    return scores.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)


def off_corpus_gates(rankings: DataFrame, questions: DataFrame, configs: list[str], threshold: float = 0.0, top_n: int = 5) -> DataFrame:
    """(config, qid, refused) of off-corpus questions (qid) in each configuration, from rankings (config, qid, rank, score): the gate sees the top_n of a ranking, and one without any row refuses."""
    keyed = rankings.filter(F.col("rank") <= top_n).select(F.struct("config", "qid").alias("query_id"), F.col("score").alias("rerank_score"))
    every = questions.select("qid").distinct().select(F.explode(F.array(*map(F.lit, configs))).alias("config"), "qid").select(F.struct("config", "qid").alias("query_id"))
    return refusals(every, keyed, threshold).select("query_id.config", "query_id.qid", "refused")


def refusal_accuracy(gates: DataFrame) -> DataFrame:
    """(config, refused, n) over the off-corpus questions of gates (config, qid, refused)."""
    return gates.groupBy("config").agg(F.count_if("refused").alias("refused"), F.count("*").alias("n"))


NUMBER = r"-?\d+(?:\.\d+)?"


def value_present(text: Column, value: Column, tolerance: Column) -> Column:
    """Whether any number in the text is within the tolerance of the value; no value is never present."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.coalesce(F.exists(numbers, lambda x: F.abs(x - value) <= tolerance + 1e-9), F.lit(False))


def numeric_report(answers: DataFrame) -> DataFrame:
    """Answer and context accuracy and their gap, of answers (answer, context, value, tolerance, refused)."""
    right = value_present(F.col("answer"), F.col("value"), F.col("tolerance")) & ~F.col("refused")
    there = value_present(F.col("context"), F.col("value"), F.col("tolerance"))
    out = answers.select(right.cast("double").alias("a"), there.cast("double").alias("c")).agg(F.count("*").alias("n"), F.avg("a").alias("answer_accuracy"), F.avg("c").alias("context_accuracy"))
    return out.withColumn("gap", F.col("context_accuracy") - F.col("answer_accuracy"))


def set_recall(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, recall, passed) of answers (qid, text, items array, min_recall): the share of expected names that the vocabulary (name) has and the text holds, in any case.

    Only expected names are looked for: those that the vocabulary has are found first and meet the names of answers by an equi-join, to which they are sent if they are at most SENT_NAMES.
    Texts meet the names of their own question only, so a text moves once, however many names are expected.
    """
    wanted = answers.select(F.explode("items").alias("name")).distinct()
    known = cut(vocabulary.select("name").join(wanted, "name", "left_semi").distinct())
    sent = F.broadcast(known) if known.limit(SENT_NAMES + 1).count() <= SENT_NAMES else known
    names = answers.select("qid", F.explode(F.array_distinct("items")).alias("name")).join(sent, "name", "left_semi").groupBy("qid").agg(F.collect_set("name").alias("__names"))
    met = answers.join(names, "qid", "left").withColumn("__said", F.lower(F.coalesce("text", F.lit(""))))
    held = F.size(F.filter("__names", lambda n: F.contains("__said", F.lower(n))))
    recall = F.when(F.size("__names") > 0, held / F.size(F.array_distinct("items")))
    out = met.select("qid", "min_recall", F.coalesce(recall, F.lit(0.0)).alias("recall"))
    return out.select("qid", "recall", (F.col("recall") >= F.col("min_recall")).alias("passed"))


def judge_score(text: Column) -> Column:
    """The first digit from 1 to 5 of a judge's text, or null."""
    return F.nullif(F.regexp_extract(text, "([1-5])", 1), F.lit("")).cast("int")


def score_distribution(judged: DataFrame) -> DataFrame:
    """(score, n, share) of judged (judge_text), unparsed ones under null."""
    counts = judged.select(judge_score(F.col("judge_text")).alias("score")).groupBy("score").agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("all"))).select("score", "n", (F.col("n") / F.col("all")).alias("share"))


def faithfulness(judged: DataFrame) -> DataFrame:
    """One row of n, parsed and mean_score of judged (judge_text)."""
    return judged.select(judge_score(F.col("judge_text")).alias("s")).agg(F.count("*").alias("n"), F.count("s").alias("parsed"), F.avg("s").alias("mean_score"))


def least_faithful(judged: DataFrame, n: int = 5) -> DataFrame:
    """(qid, score) of the n lowest scores of judged (qid, judge_text), ties by qid; texts without a score are left out."""
    return judged.select("qid", judge_score(F.col("judge_text")).alias("score")).filter("score is not null").orderBy("score", "qid").limit(n)


def by_type(scores: DataFrame) -> DataFrame:
    """(type, n, hit_1, mrr) of scored questions with a type."""
    return scores.groupBy("type").agg(F.count("*").alias("n"), F.avg("hit_1").alias("hit_1"), F.avg("rr").alias("mrr"))


@F.pandas_udf(DoubleType())
def mcnemar(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Exact two-sided p of McNemar's test: as uneven or more by a fair coin for each discordant pair.

    The greatest term of the tail is taken in log space; each next one is the last times i / (n - i + 1), and what can't change the sum any more is not added.
    """

    def one(b: int, c: int) -> float:
        n, least = b + c, min(b, c)
        if 2 * least == n:
            return 1.0
        term = total = math.exp(math.lgamma(n + 1) - math.lgamma(least + 1) - math.lgamma(n - least + 1) - n * math.log(2))
        for i in range(least, 0, -1):
            term *= i / (n - i + 1)
            total += term
            if term < total * 1e-18:
                break
        return min(1.0, 2 * total)

    return pd.Series([one(int(b), int(c)) for b, c in zip(only_a, only_b, strict=True)], dtype=float)


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Questions that only a, or only b, has right at rank 1, how many have both or neither, and the exact p of so uneven a split: one row."""
    wide = scores.filter(F.col("config").isin(a, b)).groupBy("qid").agg(F.max(F.when(F.col("config") == a, F.col("hit_1"))).alias("a"), F.max(F.when(F.col("config") == b, F.col("hit_1"))).alias("b"))
    counts = wide.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither"))
    return counts.withColumn("p_value", mcnemar("only_a", "only_b"))


def url_prefixes(url: Column) -> Column:
    """The paths on the way to a page, from the first directory to the page itself: /a/, /a/b/, /a/b/c."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/]*)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    inner = lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.when((i < n) | path.endswith("/"), "/").otherwise(""))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), inner)).otherwise(F.array(F.lit("/")))


def failure_families(wrong: DataFrame, least: int) -> DataFrame:
    """(config, family, n) of wrong rank-1 rows (config, source_url): every row counts once, under the longest path on its way that at least `least` rows of all configurations share, or under `other`.

    Families are found in the rows and not given: the paths of all rows are a prefix tree, and the supported nodes that lie deepest are its families. A null url has no path and counts under `other`.
    """
    rows = wrong.groupBy("config", "source_url").agg(F.count("*").alias("n")).withColumn("prefixes", F.when(F.col("source_url").isNotNull(), url_prefixes(F.col("source_url"))))
    support = rows.select(F.explode("prefixes").alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
    each = rows.select("config", "source_url", "n", F.posexplode_outer("prefixes").alias("depth", "prefix")).join(support.select("prefix", F.lit(True).alias("supported")), "prefix", "left")
    deepest = each.groupBy("config", "source_url", "n").agg(F.max_by("prefix", F.when(F.col("supported"), F.col("depth"))).alias("family"))
    return deepest.groupBy("config", F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("n").alias("n"))


def hit_by_tercile(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """(config, tercile, n, hit_1) by thirds of the questions, in the order of their mean gold length, lengths (qid, mean_length), ties by qid; the first thirds take what is left over."""
    placed = numbered(lengths, F.col("mean_length"), F.col("qid"), column="place")
    total = placed.count()
    size, more = divmod(total, 3)
    place, long_ones = F.col("place"), more * (size + 1)
    third = F.when(place <= long_ones, F.ceil(place / (size + 1))).otherwise(more + F.ceil((place - long_ones) / max(size, 1)))
    return scores.join(placed.select("qid", third.cast("int").alias("tercile")), "qid").groupBy("config", "tercile").agg(F.count("*").alias("n"), F.avg("hit_1").alias("hit_1"))


def derive_labels(specs: DataFrame, champions: DataFrame, abilities: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, value, items) of specs (qid, patch, lookup, champion, slot, field, rank, item, phrase, tag) against the tables as they are.

    `ability` takes the field at the rank, `item` its gold_total or a stat, `champion` a stat; `items_with` the sorted names of all items of the phrase. What
    can't be looked up any more has neither a value nor items.
    """
    a, c, i, w = (specs.filter(F.col("lookup") == kind) for kind in ("ability", "champion", "item", "items_with"))
    none, names = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    identified = lambda rows: champion_ids(rows.withColumn("query_id", F.col("qid")), champions)
    ranked = identified(a).select("qid", F.col("id").alias("champion_id"), "slot", "patch", "rank", "field")
    parts = ability_values(ranked, abilities)
    field = F.coalesce(*(F.when(F.col("field") == f, F.col(f)) for f in ("cooldown", "cost", "range")))
    out = parts.select("qid", field.alias("value"), names.alias("items"))
    stat = F.try_element_at("stats", F.col("field"))
    out = out.unionByName(identified(c).join(champions.select("id", "patch", "stats"), ["id", "patch"], "left").select("qid", stat.alias("value"), names.alias("items")))
    found = item_by_name(i.select("qid", "patch", "item", "field"), items)
    out = out.unionByName(found.select("qid", F.when(F.col("field") == "gold_total", F.col("gold_total").cast("double")).otherwise(stat).alias("value"), names.alias("items")))
    listed = with_stat(items, w.select("phrase", "tag").distinct()).groupBy("phrase", "patch").agg(F.array_sort(F.collect_set("name")).alias("items"))
    return out.unionByName(w.select("qid", "phrase", "patch").join(listed, ["phrase", "patch"], "left").select("qid", none.alias("value"), "items"))


def label_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, status) of labels (qid, value, items) that changed or have no new value (dead); lists are compared as sets."""
    fresh = new.select("qid", F.col("value").alias("__v"), F.array_sort(F.array_distinct("items")).alias("__i"), F.lit(True).alias("__there"))
    met = old.join(fresh, "qid", "left")
    dead = F.col("__there").isNull() | (F.col("__v").isNull() & F.col("__i").isNull())
    changed = ~F.col("value").eqNullSafe(F.col("__v")) | ~F.array_sort(F.array_distinct("items")).eqNullSafe(F.col("__i"))
    return met.withColumn("status", F.when(dead, "dead").when(changed, "changed")).filter("status is not null").select("qid", "status")


LABEL = "question string, type string, value double, items array<string>"


def refresh_lines(lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lines (at, line) of a label file with the values of fresh (qid, value, items), by question: numeric labels take the value and multi_row labels the items, if they have changed.

    All other lines, comments, blanks and labels of other types among them, stay byte for byte as they are, and so do labels without a fresh value. Adds `changed`.
    """
    label = F.from_json("line", LABEL)
    read = lines.withColumn("label", F.when(~F.startswith(F.ltrim("line"), F.lit("#")), label))
    new = fresh.select(F.col("qid").alias("__qid"), F.col("value").alias("__value"), F.array_sort("items").alias("__items")).dropDuplicates(["__qid"])
    met = read.join(new, read["label.question"] == new["__qid"], "left")
    number = (F.col("label.type") == "numeric") & F.col("__value").isNotNull() & ~F.col("label.value").eqNullSafe(F.col("__value"))
    several = (F.col("label.type") == "multi_row") & F.col("__items").isNotNull() & ~F.array_sort("label.items").eqNullSafe(F.col("__items"))
    changed = F.coalesce(number | several, F.lit(False))
    rewritten = _with_value("line", F.when(number, F.to_json(F.struct(F.col("__value").alias("value")))).otherwise(F.to_json(F.struct(F.col("__items").alias("items")))))
    return met.select("at", F.when(changed, rewritten).otherwise(F.col("line")).alias("line"), changed.alias("changed"))


@F.pandas_udf(StringType())
def _with_value(line: pd.Series, value: pd.Series) -> pd.Series:
    """Each JSON line with the fields of `value` in place of its own, whose order stays; whole numbers are written as such."""

    def one(old: str, new: str) -> str:
        fields = {k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in json.loads(new or "{}").items()}
        try:
            return json.dumps(json.loads(old) | fields, ensure_ascii=False)
        except ValueError:
            return old

    return pd.Series([one(o, n) for o, n in zip(line, value, strict=True)], dtype=object)


def dead_urls(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, source_url) of expected (qid, corpus, expected_urls) that no chunk of the corpus has."""
    urls = expected.select("qid", "corpus", F.explode("expected_urls").alias("source_url"))
    return urls.join(chunks.select("corpus", "source_url").distinct(), ["corpus", "source_url"], "left_anti").select("qid", "source_url")


def behaviour(expected: DataFrame, classified: DataFrame) -> DataFrame:
    """(n, right, stray) of expected (query_id, kind) against classified (query_id, kind): null-safe equality, and pinned questions (no kind) that classify."""
    met = expected.select("query_id", F.col("kind").alias("want")).join(classified.select("query_id", F.col("kind").alias("got")), "query_id", "left")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("want").eqNullSafe(F.col("got"))).alias("right"), F.count_if(F.col("want").isNull() & F.col("got").isNotNull()).alias("stray"))
