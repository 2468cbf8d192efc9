"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its character n-grams (hashed into buckets), as in fastText's
classifier. Embeddings and output weights are trained together by stochastic gradient descent in
numpy on a bounded labelled sample. A quarter of the sample calibrates: a temperature makes the
greatest softmax value a probability, and the least value that is trusted becomes the limit of rejection.

As mean and output are linear, a text's logits are the mean of one precomputed row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, map_texts
from tidemark.llm.samples import fold, labelled_sample, row_key
from tidemark.llm.shared import unused

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRule:
    """Training reads at most `per_language` whole texts of each label, and no more of them than have `bytes_per_language` bytes together, or one."""

    sizes: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 16
    width: int = 16
    per_language: int = 500
    bytes_per_language: int = 4 << 20
    epochs: int = 6
    rate: float = 0.5
    #: Share of the rightly named calibration texts that rejection may cost.
    cost: float = 0.001
    #: A text as sure as this is never rejected, however sure the calibration texts are.
    most_least: float = 0.6
    seed: int = 5


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    rule: LanguageRule

    def probabilities(self, block: TextBlock) -> np.ndarray:
        total, n = np.zeros((block.n, len(self.languages))), np.zeros(block.n)
        for size in self.rule.sizes:
            doc, bucket = _buckets(block, size, self.rule)
            n += block.sums(doc)
            for k in range(len(self.languages)):
                total[:, k] += block.sums(doc, self.rows[bucket, k])
        return _softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def _buckets(block: TextBlock, size: int, rule: LanguageRule) -> tuple[np.ndarray, np.ndarray]:
    doc, h = block.grams(size)
    return doc, (h & np.uint64(rule.buckets - 1)).astype(np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], languages: list[str], rule: LanguageRule = LanguageRule()) -> LanguageModel:
    rng = np.random.default_rng(rule.seed)
    y = np.array([languages.index(x) for x in labels], np.int64)
    features = []
    for text in texts:
        block = TextBlock(pa.array([text]), fold=True)
        found, counts = np.unique(np.concatenate([_buckets(block, s, rule)[1] for s in rule.sizes]), return_counts=True)
        features.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    order = rng.permutation(len(texts))
    held, learn = order[: len(order) // 4], order[len(order) // 4 :]
    embed = rng.normal(0, 1 / rule.width, (rule.buckets, rule.width)).astype(np.float32)
    out, bias = np.zeros((rule.width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(rule.epochs):
        rate = rule.rate * (1 - epoch / rule.epochs)
        for i in rng.permutation(learn):
            at, share = features[i]
            mean = share @ embed[at]
            error = _softmax((mean @ out + bias)[None])[0]
            error[y[i]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embed[at] -= rate * len(at) * share[:, None] * back / max(1, len(at)) ** 0.5
    rows = (embed @ out).astype(np.float64)
    logits = np.array([share @ rows[at] for at, share in (features[i] for i in held)]).reshape(len(held), len(languages)) + bias
    temperature, least = 1.0, 0.0
    if len(held):
        grid = 2.0 ** np.arange(-4, 4.1, 0.25)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / temperature)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            least = float(min(rule.most_least, np.quantile(p.max(axis=1)[right], rule.cost) * 0.9))
    return LanguageModel(tuple(languages), rows, bias.astype(np.float64), temperature, least, rule)


def fit(docs: DataFrame, trains: Column, rule: LanguageRule = LanguageRule()) -> LanguageModel:
    """A model of `text` and `lang` of the rows where `trains` holds; rows without a label or letter teach nothing."""
    usable = docs.filter(trains).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = usable.select("lang", row_key().alias("key"), F.octet_length("text").cast("long").alias("n"))
    rows = labelled_sample(keyed, usable, "lang", rule.per_language, rule.bytes_per_language)
    return train([text for text, _ in rows], [lang for _, lang in rows], sorted({lang for _, lang in rows}), rule)


def _judged(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...], carry_text: bool) -> tuple[DataFrame, str, str, str]:
    """The columns `keep` with language, score and acceptance, and the names of these three, which `docs` doesn't have; the one verdict that both operators below give."""
    best, p, lettered, lang, score, accepted = unused(docs, "best", "p", "lettered", "lang", "score", "accepted")

    def name(block: TextBlock) -> dict:
        if not model.languages:
            return {best: [UNKNOWN] * block.n, p: np.zeros(block.n)}
        found = model.probabilities(block)
        return {best: np.array(model.languages, object)[found.argmax(axis=1)], p: found.max(axis=1)}

    asked = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(lettered))
    named = map_texts(asked, name, f"{best} string, {p} double", keep=(*keep, lettered), fold=True, carry_text=carry_text)
    judged = named.select(
        *(c for c in named.columns if c not in (best, p, lettered)),
        F.when(F.col(lettered), F.col(best)).otherwise(UNKNOWN).alias(lang),
        F.when(F.col(lettered), F.col(p)).otherwise(0.0).alias(score),
        (F.col(lettered) & (F.col(p) >= model.least) & (F.col(best) != UNKNOWN)).alias(accepted),
    )
    return judged, lang, score, accepted


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) and accepted of every document.

    One row per row of `docs`. A null text, or one without a letter, gets `und`, score 0 and is not accepted; so does
    every text if the model has no language. A text whose score is below the model's limit keeps its best language and
    is not accepted; nor is one whose best language is itself called `und`. Only doc_id and text are read.
    """
    judged, *found = _judged(docs, model, ("doc_id",), False)
    return judged.select("doc_id", *(F.col(c).alias(name) for c, name in zip(found, ("lang_pred", "score", "accepted"), strict=True)))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, all columns, that `identify` accepts."""
    judged, *_, accepted = _judged(docs, model, tuple(c for c in docs.columns if c != "text"), True)
    return judged.filter(F.col(accepted)).select(*docs.columns)


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
