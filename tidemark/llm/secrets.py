"""Secret scans with DataFrame expressions only.

Named patterns give the base spans. The method adds spans by entropy: every candidate string (a long
run of key characters that holds a digit and a letter) belongs to a character class, and a window
slides over it. The window's Shannon entropy follows from the counts of its characters, which change by the character that
leaves and the one that enters; the stretch from the first to the last window at or above the class's
limit is a span. Base spans are cut out of a candidate, and what is left of it on either side is judged as
a candidate of its own. Strings on the allow list add nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import unused

#: Fixed patterns of the base kinds, in listed order: (kind, pattern, least length, measured group).
BASE = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
)
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRule:
    """`needs`: patterns that a candidate must hold; a key without a digit or without a letter is no candidate. `classes`: (name, pattern
    of the whole candidate, least entropy in bits a character), first match counts; a candidate of no class has no limit and adds nothing."""

    candidate: str = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
    needs: tuple[str, ...] = ("[0-9]", "[A-Za-z]")
    window: int = 24
    classes: tuple[tuple[str, str, float], ...] = (
        ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
        ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
        ("base64", r"^[A-Za-z0-9+/_-]+$", 3.9),
    )
    #: Java patterns of harmless strings: UUIDs, file and URL paths, and words joined by marks. Loops over groups are possessive, so that long strings need no deep stack.
    allow: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^/*(?:[A-Za-z_-]{1,20}[0-9]{0,4}/+)++[A-Za-z0-9_-]{0,23}$",
        r"^(?:[A-Za-z]{1,15}[0-9]{0,3}[_-]+)++[A-Za-z]{0,15}[0-9]{0,4}$",
        r"(?i)^(?:example|sample|dummy|placeholder)",
    )


def _cuts(text: Column, pattern: str) -> Column:
    """Everything up to and including each leftmost match, one piece a match."""
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))


def _bound(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once however often `body` names it."""
    return F.transform(F.array(value), body)[0]


#: Matches of a block of running values; pieces of a text that are cut out of one part of it.
BLOCK, PART = 128, 256


def _running(values: Column, merge, levels: int = 2) -> Column:
    """Inclusive running `merge` (a sum, a maximum) of an array of non-negative integers.

    Spark copies a fold's whole state at every step, so a fold that gathers an array costs the square of its length. Here
    blocks of 128 values are run by themselves, their last values run likewise one level up, and what a block inherits is merged in.
    """
    zero = F.lit(0)
    if levels == 0:
        return _bound(values, lambda v: F.transform(v, lambda _, i: F.aggregate(F.slice(v, 1, i + 1), zero, merge)))

    def blocks(v):
        part = lambda b: _running(F.slice(v, b * BLOCK + 1, BLOCK), merge, 0)
        return F.transform(F.sequence(zero, ((F.size(v) - 1) / BLOCK).cast("int")), part)

    def carried(x):
        before = _running(F.transform(x, lambda own: F.coalesce(F.try_element_at(own, F.lit(-1)), zero)), merge, levels - 1)
        return _bound(before, lambda at: F.flatten(F.transform(x, lambda own, k: F.transform(own, lambda y: merge(F.when(k > 0, at[k - 1]).otherwise(zero), y)))))

    return _bound(values, lambda v: _bound(blocks(v), carried))


def _located(docs: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """`docs` with a column for each of `patterns` (column, pattern): array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    Time is linear in the matches. Columns are made one upon the other, as Spark resolves one level of nested functions at a time.
    """
    ends = dict(zip(patterns, unused(docs, *(f"ends{k}" for k in range(len(patterns)))), strict=True))
    one = lambda m, end: F.struct((end - F.char_length(m["value"])).alias("start"), end.alias("end"), m["value"].alias("value"))
    match = lambda p: lambda x: F.struct(F.char_length(x).alias("size"), F.regexp_extract(x, f"(?:{p})$", 0).alias("value"))
    out = docs.withColumns({c: F.transform(_cuts(text, p), match(p)) for c, p in patterns.items()}).withColumns({ends[c]: _running(F.transform(c, lambda m: m["size"]), lambda a, b: a + b) for c in patterns})
    return out.withColumns({c: F.zip_with(c, ends[c], one) for c in patterns}).drop(*ends.values())


def _gaps(spans: Column, length: Column) -> Column:
    """array<struct<lo, hi>>, ascending: what `spans` (sorted by start, overlapping or not) leave of a text; gaps between spans that touch, and at either end, may be empty."""

    def around(s):
        gap = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        reach = _running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def between(r):
            before = F.transform(s, lambda x, i: gap(F.when(i > 0, r[i - 1]).otherwise(0), x["start"]))
            last = gap(F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0)), length)
            return F.filter(F.concat(before, F.array(last)), lambda g: g["lo"] <= g["hi"])

        return _bound(reach, between)

    return _bound(spans, around)


def _leading(items: Column, holds) -> Column:
    """How many of `items`, one at least, `holds` is true for, if it is true for the first ones and for no later one; found by halving."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))

    def step(acc, _):
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        more = (acc["lo"] < acc["hi"]) & holds(items[F.least(middle, F.size(items) - 1)])
        return F.struct(F.when(more, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["hi"]).otherwise(F.least(middle, acc["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.size(items))).cast("int")), begin, step, lambda acc: acc["lo"])


def _pieces(body: Column, spans: Column) -> Column:
    """array<struct<start, end, value>> of ascending, disjoint `spans` (lo, hi) of a text. A piece is cut out of the part that holds 256 of them, since reaching a code point takes as long as the text before it."""

    def part(own):
        lo, hi = F.try_element_at(own, F.lit(1))["lo"], F.try_element_at(own, F.lit(-1))["hi"]
        near = F.struct(lo.alias("lo"), F.substr(body, lo + 1, hi - lo).alias("text"))
        cut = lambda n: lambda p: F.struct(p["lo"].alias("start"), p["hi"].alias("end"), F.substr(n["text"], p["lo"] - n["lo"] + 1, p["hi"] - p["lo"]).alias("value"))
        return _bound(near, lambda n: F.transform(own, cut(n)))

    return _bound(spans, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / PART).cast("int")), lambda b: _bound(F.slice(s, b * PART + 1, PART), part))))


def _typed(kind: str, spans: Column) -> Column:
    order = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _base(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with `secret_base`."""
    column = dict(zip((kind for kind, *_ in BASE), unused(docs, *(kind for kind, *_ in BASE)), strict=True))
    out = _located(docs, text, {column[kind]: pattern for kind, pattern, _, _ in BASE})
    long_enough = lambda pattern, least, group: lambda s: F.char_length(F.regexp_extract(s["value"], pattern, group)) >= least
    kept = [_typed(kind, F.filter(column[kind], long_enough(pattern, least, group))) for kind, pattern, least, group in BASE]
    return out.withColumn("secret_base", F.array_sort(F.concat(*kept))).drop(*column.values())


#: The key characters. Their counts in a window are packed, 12 to a word of 5 bits each; other characters share the last place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BITS, IN_WORD = 5, 12
WORDS = -(-(len(ALPHABET) + 1) // IN_WORD)
#: Fractions of a bit in a window's sum, which is a whole number so that it stays exact however far the window slides.
PARTS = 1 << 32


def _fixed(values: list, kind: str) -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def _places(value: Column) -> Column:
    """array<int>: for every character, the word of its count times 64 plus the bit where it starts."""
    number = lambda k: k // IN_WORD * 64 + k % IN_WORD * BITS
    table = _fixed([number(len(ALPHABET)), *map(number, range(len(ALPHABET)))], "int")
    return F.transform(F.split(value, ""), lambda c: table[F.call_function("instr", F.lit(ALPHABET), c)])


def _hot_stretch(value: Column, rule: EntropyRule) -> Column:
    """struct<first, last> of the 0-based starts of windows at or above the limit; first is null if none is.

    The fold holds the window's packed counts and its sum of n log2 n. A step takes out the character that leaves and puts in the
    one that enters; entropy is log2(window) - sum / window, so high entropy is a low sum.
    """
    w = rule.window
    if w >= 1 << BITS:
        raise ValueError(f"a window has fewer than {1 << BITS} characters")
    most = F.lit(-1).cast("long")
    for _, pattern, least in reversed(rule.classes):
        most = F.when(value.rlike(pattern), F.lit(math.floor(w * (math.log2(w) - least) * PARTS + 1e-3)).cast("long")).otherwise(most)
    weight = _fixed([round(n * math.log2(n) * PARTS) if n else 0 for n in range(w + 2)], "bigint")
    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).cast("long").alias("sum"), _fixed([0] * WORDS, "bigint").alias("counts"), none.alias("first"), none.alias("last"))

    def count(counts: Column, place: Column) -> Column:
        return F.call_function("shiftright", counts[F.shiftright(place, 6)], place.bitwiseAND(63)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def fold(bound: Column) -> Column:
        places = bound["places"]

        def step(acc, i):
            full = i >= w
            enters, leaves = places[i], F.when(full, places[i - w])
            n, m = count(acc["counts"], enters) - F.when(full & (enters == leaves), 1).otherwise(0), count(acc["counts"], leaves)
            total = acc["sum"] + weight[n + 1] - weight[n] + F.when(full, weight[m - 1] - weight[m]).otherwise(F.lit(0).cast("long"))
            one = lambda place, k: F.when(F.shiftright(place, 6) == k, F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
            counts = F.transform(acc["counts"], lambda x, k: x + one(enters, k) - one(leaves, k))
            hot = (i >= w - 1) & (total <= bound["most"])
            at = i - (w - 1)
            return F.struct(total.alias("sum"), counts.alias("counts"), F.when(hot & acc["first"].isNull(), at).otherwise(acc["first"]).cast("int").alias("first"), F.when(hot, at).otherwise(acc["last"]).cast("int").alias("last"))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.transform(F.array(F.struct(_places(value).alias("places"), most.alias("most"))), fold)[0]


def _apart(runs: Column, gaps: Column) -> Column:
    """array<struct<lo, hi>>: what `gaps` leave of disjoint `runs`; both ascend, so that a run's gaps are a slice."""

    def own(g):
        def met(r):
            first = _leading(g, lambda x: x["hi"] <= r["start"])
            ends = F.struct(first.alias("first"), _leading(g, lambda x: x["lo"] < r["end"]).alias("stop"))
            within = lambda x: F.struct(F.greatest(x["lo"], r["start"]).alias("lo"), F.least(x["hi"], r["end"]).alias("hi"))
            return _bound(ends, lambda e: F.transform(F.slice(g, e["first"] + 1, e["stop"] - e["first"]), within))

        return F.flatten(F.transform(runs, met))

    return _bound(gaps, own)


def _entropy(docs: DataFrame, text: Column, out: str, rule: EntropyRule) -> DataFrame:
    """`docs`, which has `secret_base`, with the spans of the method in the column `out`."""
    runs, gaps, left, hits = unused(docs, "runs", "gaps", "left", "hits")

    def counts(s):
        fits = F.char_length(s["value"]) >= rule.window
        for p in rule.needs:
            fits = fits & s["value"].rlike(p)
        return fits & ~_any(s["value"], rule.allow)

    found = _located(docs, text, {runs: rule.candidate}).withColumns({runs: F.filter(runs, counts), gaps: _gaps(F.col("secret_base"), F.char_length(text))})
    apart = found.withColumn(left, F.filter(_apart(F.col(runs), F.col(gaps)), lambda p: p["hi"] - p["lo"] >= rule.window))
    judged = apart.withColumn(hits, F.filter(_pieces(text, F.col(left)), counts))
    scored = F.transform(hits, lambda s: F.struct(s["start"].alias("at"), _hot_stretch(s["value"], rule).alias("hot")))
    warm = F.filter(scored, lambda s: s["hot"]["first"].isNotNull())
    spans = F.transform(warm, lambda s: F.struct((s["at"] + s["hot"]["first"]).alias("start"), (s["at"] + s["hot"]["last"] + rule.window).alias("end"), F.lit("").alias("value")))
    return judged.withColumn(out, spans).drop(runs, gaps, left, hits)


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule(), text: str = "text") -> DataFrame:
    """`docs` with the columns `secret_base` and `secret_spans`: array<struct<start, order, end, kind>>, sorted by (start, kind as listed).

    Offsets are code points, ends exclusive. A null text counts as empty and has no spans. Rows
    are not dropped, merged or reordered, and an empty table gives an empty one; all other columns stay, and existing columns of those two names
    are replaced. Spans that start together are in the order of kinds. A text of any length is scanned whole, in time that is linear in it
    and in its matches (but for sorting spans).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    (warm,) = unused(docs, "warm")
    out = _entropy(_base(docs, body), body, warm, rule)
    return out.withColumn("secret_spans", F.array_sort(F.concat("secret_base", _typed("entropy", F.col(warm))))).drop(warm)


def secret_digests(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """doc_id, the counts of base spans, the digest of the base spans and all spans as a string."""
    found = scan_secrets(docs.select("doc_id", "text"), rule)
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rule: EntropyRule = EntropyRule(), text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by `mark`; overlapping spans get one mark. Other columns stay as they are."""
    found = scan_secrets(docs, rule, text)
    body, spans = F.col(text), F.col("secret_spans")
    (gaps,) = unused(found, "gaps")
    between = F.transform(_pieces(body, F.col(gaps)), lambda p: p["value"])
    out = found.withColumn(gaps, _gaps(spans, F.char_length(body)))
    return out.withColumn(text, F.when(F.size(spans) > 0, F.array_join(between, mark)).otherwise(body)).drop("secret_base", "secret_spans", gaps)
