"""Column expressions on names, markup, paths and lines."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(name: Column) -> Column:
    """Lower case; possessive and plain apostrophes go; every other run outside a-z and 0-9 is one space."""
    lowered = F.regexp_replace(F.lower(name), r"'s\b", "")
    return F.trim(F.regexp_replace(F.replace(lowered, F.lit("'"), F.lit("")), "[^a-z0-9]+", " "))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether any of a few fixed strings is in `text`."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def has_word(padded_text: Column, words: tuple[str, ...]) -> Column:
    return has_any(padded_text, tuple(f" {w} " for w in words))


#: Line breaks as str.splitlines takes them.
_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAK = re.compile(_BREAKS)


def unescape_entities(text: Column) -> Column:
    """HTML's character references resolved: named ones, with the semicolon or without it where HTML allows that, and numeric ones. Texts without an ampersand reach Python as nulls."""

    def resolve(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return F.coalesce(F.pandas_udf(resolve, "string")(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_markup(text: Column) -> Column:
    """Plain text of game markup: placeholders and tags go, breaks become spaces, entities are resolved, white space is collapsed; null gives the empty string."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{\{[^}]*\}\}", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    out = unescape_entities(F.regexp_replace(out, "<[^>]+>", ""))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def doc_url(path: Column, base: str) -> Column:
    """Public URL of a documentation path: the suffix and a trailing index go."""
    short = F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), r"(^|/)index$", "")
    return F.when(short == "", F.lit(base)).otherwise(F.concat(F.lit(base), short, F.lit("/")))


#: Elements whose content goes with them, the names of tags that are unwrapped, and the patterns of comments, elements and tags.
DROPPED = "script|style|noscript|iframe"
TAGS = (
    "a|abbr|address|area|article|aside|audio|b|base|bdi|bdo|blockquote|br|button|canvas|caption|cite|code|col|colgroup|data|datalist|dd|del|details|dfn|dialog|"
    "div|dl|dt|em|embed|fieldset|figcaption|figure|font|footer|form|h1|h2|h3|h4|h5|h6|header|hr|i|iframe|img|input|ins|kbd|label|legend|li|main|map|mark|nav|"
    "noscript|object|ol|optgroup|option|output|p|param|picture|pre|progress|q|rp|rt|ruby|s|samp|script|section|select|small|source|span|strong|style|sub|summary|"
    "sup|svg|table|tbody|td|template|textarea|tfoot|th|thead|time|title|tr|track|u|ul|var|video|wbr"
)
COMMENT_PATTERN = r"(?s)<!--.*?-->"
ELEMENT_PATTERN = rf"(?is)<({DROPPED})\b[^>]*>.*?</\1\s*>"
TAG_PATTERN = rf"(?i)</?\s*(?:{TAGS})\b[^>]*>"


def clean_html(text: Column) -> tuple[Column, Column]:
    """(cleaned text, removed pieces) of prose without code fences: comments and embeds go, known tags become a space, white space behind a line's indent is tidied."""
    removed = F.regexp_count(text, F.lit(COMMENT_PATTERN)) + F.regexp_count(text, F.lit(ELEMENT_PATTERN)) + F.regexp_count(text, F.lit(TAG_PATTERN))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMENT_PATTERN, ""), ELEMENT_PATTERN, ""), TAG_PATTERN, " ")
    out = F.regexp_replace(out, r"(?<=[^ \n]) {2,}", " ")
    out = F.regexp_replace(out, r"(?md)^( *)([^\n]*?)[^\S\n]*$", "$1$2")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\n+|\n+\z", ""), removed.cast("long")


_MARK = r"[^\S\n]*(?:`{3}|~{3})"
#: A fenced block up to its closing line or the end, or the lines up to the next fence; every line has its break.
FENCED_OR_PROSE = rf"(?md)^[^\S\n]*(`{{3}}|~{{3}})[^\n]*\n(?:(?s:.*?)^[^\S\n]*\1[^\n]*\n|(?s:.*))|^(?!{_MARK})(?s:.*?\n)(?={_MARK}|\z)"


def clean_markdown(text: Column) -> tuple[Column, Column]:
    """(cleaned text, removed pieces) of markdown: `clean_html` of every run of lines outside code fences; fenced blocks stay as they are. Null counts as empty."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), _BREAKS, "\n")
    whole = F.when((lines == "") | F.endswith(lines, F.lit("\n")), lines).otherwise(F.concat(lines, F.lit("\n")))
    pieces = F.transform(F.regexp_extract_all(whole, F.lit(FENCED_OR_PROSE), F.lit(0)), lambda p: F.substr(p, F.lit(1), F.char_length(p) - 1))

    def clean(piece: Column) -> Column:
        cleaned, removed = clean_html(piece)
        fenced = piece.rlike(rf"^{_MARK}")
        return F.struct(F.when(fenced, piece).otherwise(cleaned).alias("text"), F.when(fenced, F.lit(0).cast("long")).otherwise(removed).alias("removed"))

    done = F.transform(pieces, clean)
    return F.array_join(F.transform(done, lambda d: d["text"]), "\n"), F.aggregate(done, F.lit(0).cast("long"), lambda n, d: n + d["removed"])


def line_slice(lines: Column, spec: Column) -> Column:
    """Lines that a spec such as '2:4,7' selects: 1-based and inclusive, swapped bounds are put right, the file bounds clamp, malformed parts give nothing, parts keep the spec's order; trailing blank lines go."""
    n = F.size(lines)

    def part(p: Column) -> Column:
        bounds = F.split(F.trim(p), r"\s*:\s*")
        ok = F.trim(p).rlike(r"^\d+(\s*:\s*\d+)?$")
        first, last = F.try_element_at(bounds, F.lit(1)).try_cast("int"), F.coalesce(F.try_element_at(bounds, F.lit(2)), F.try_element_at(bounds, F.lit(1))).try_cast("int")
        lo, hi = F.greatest(F.least(first, last), F.lit(1)), F.least(F.greatest(first, last), n)
        return F.when(ok & (hi >= lo), F.slice(lines, F.when(hi >= lo, lo).otherwise(1), F.when(hi >= lo, hi - lo + 1).otherwise(0))).otherwise(F.array().cast("array<string>"))

    chosen = F.flatten(F.transform(F.split(spec, ","), part))
    kept = F.array_max(F.transform(chosen, lambda x, i: F.when(F.trim(x) != "", i + 1).otherwise(0)))
    return F.slice(chosen, 1, F.coalesce(kept, F.lit(0)))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; marks that combine with a letter belong to it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))


#: Words that carry no meaning of their own in English.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
