"""Porter's stemmer (1980), applied to distinct words only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_MEASURE = re.compile(f"^(?:{_CS})?((?:{_VS}{_CS})*)(?:{_VS})?$")
_HAS_VOWEL = re.compile(f"^(?:{_CS})?{_V}")
_SHORT = re.compile(f"^{_CS}{_V}[^aeiouwxy]$")
#: Fixed values of the published algorithm: suffix and replacement of steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _m(stem: str) -> int:
    found = _MEASURE.match(stem)
    return len(re.findall(f"{_VS}{_CS}", found[1])) if found else 0


def _swap(word: str, table: tuple[tuple[str, str], ...]) -> str:
    for suffix, other in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if _m(stem) > 0 else word
    return word


def porter(word: str) -> str:
    if len(word) < 3 or not word.isalpha():
        return word
    w = word
    for suffix, other in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: -len(suffix)] + other
            break
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _HAS_VOWEL.match(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _m(w) == 1 and _SHORT.match(w):
                    w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _m(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _SHORT.match(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w[:-1]) > 1 else w


def stemmed(column: str) -> Column:
    """The stem of a column of words, for rows of different words."""

    def stems(found: pd.Series) -> pd.Series:
        return found.map(lambda w: None if w is None else porter(w))

    return F.pandas_udf(stems, "string")(column)


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """`terms` with `column` stemmed; each distinct word is stemmed once and joined back."""
    vocabulary = terms.select(column).distinct().withColumn("__stem", stemmed(column))
    others = [c for c in terms.columns if c != column]
    return terms.join(vocabulary, column).select(*others, F.col("__stem").alias(column))
