"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are its distinct n-grams, hashed into buckets. Each is scaled by the log ratio
of its smoothed frequencies in toxic and clean training texts, and a logistic regression on the
scaled features is trained by gradient descent in numpy (Wang & Manning 2012). Buckets in too few
training texts, or with a ratio near 0, carry no evidence and have weight 0, so very long texts do
not gather noise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, map_texts
from tidemark.llm.samples import fold, labelled_sample, row_key


@dataclass(frozen=True)
class ToxicityRule:
    """Training reads at most `per_label` whole texts of each label, and no more of them than have `bytes_per_label` bytes together, or one."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    buckets: int = 1 << 20
    per_label: int = 1_500
    bytes_per_label: int = 12 << 20
    smoothing: float = 1.0
    least_texts: int = 8
    least_ratio: float = 1.0
    steps: int = 300
    rate: float = 0.5
    ridge: float = 1e-3
    predict_at: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    rule: ToxicityRule

    def scores(self, block: TextBlock) -> np.ndarray:
        doc, bucket = features(block, self.rule, self.weights)
        z = self.bias + block.sums(doc, self.weights[bucket])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(block: TextBlock, rule: ToxicityRule, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, bucket); only buckets with a weight if weights are given."""
    found = []
    for size in rule.sizes:
        doc, h = block.grams(size)
        bucket = (h & np.uint64(rule.buckets - 1)).astype(np.int64)
        if weights is not None:
            some = weights[bucket] != 0
            doc, bucket = doc[some], bucket[some]
        found.append(doc * rule.buckets + bucket)
    both = np.unique(np.concatenate(found))
    return both // rule.buckets, both % rule.buckets


def train(texts: list[str], labels: list[int], rule: ToxicityRule = ToxicityRule()) -> ToxicityModel:
    y = np.array(labels, np.float64)
    own = [features(TextBlock(pa.array([t]), fold=True), rule)[1].astype(np.int32) for t in texts]
    toxic, clean = np.zeros(rule.buckets), np.zeros(rule.buckets)
    for bucket, label in zip(own, labels, strict=True):
        (toxic if label else clean)[bucket] += 1
    p, q = rule.smoothing + toxic, rule.smoothing + clean
    ratio = np.log(p / (y.sum() + 2 * rule.smoothing)) - np.log(q / ((1 - y).sum() + 2 * rule.smoothing))
    ratio[(toxic + clean < rule.least_texts) | (np.abs(ratio) < rule.least_ratio)] = 0
    own = [b[ratio[b] != 0] for b in own]
    row = np.repeat(np.arange(len(own)), [len(b) for b in own])
    col = np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int64)
    kept, col = np.unique(col, return_inverse=True)
    scaled = ratio[kept][col]
    norm = max(1.0, float(np.bincount(row, scaled**2, minlength=len(own)).mean())) if len(own) else 1.0
    w, bias = np.zeros(len(kept)), 0.0
    balance = np.where(y == 1, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum()))
    for _ in range(rule.steps if len(y) else 0):
        z = bias + np.bincount(row, w[col] * scaled, minlength=len(y))
        error = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        w -= rule.rate * (np.bincount(col, error[row] * scaled, minlength=len(kept)) * len(kept) / norm / max(1.0, len(kept) / 50) + rule.ridge * w)
        bias -= rule.rate * error.sum()
    weights = np.zeros(rule.buckets)
    weights[kept] = w * ratio[kept]
    return ToxicityModel(weights, float(bias), rule)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, rule: ToxicityRule = ToxicityRule()) -> ToxicityModel:
    """A model of the texts of `docs` (doc_id, text) and `labels` (doc_id, toxic) where `trains`, on doc_id, holds. Labels other than 0 and 1 teach nothing; of several for one id the greatest counts."""
    marked = labels.filter(trains & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(trains & (F.octet_length("text") > 0))
    keyed = texts.select("doc_id", row_key().alias("key"), F.octet_length("text").cast("long").alias("n")).join(marked, "doc_id")
    rows = labelled_sample(keyed, texts, "toxic", rule.per_label, rule.bytes_per_label)
    return train([text for text, _ in rows], [toxic for _, toxic in rows], rule)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every document.

    One row per row of `docs`; a null text counts as empty and gets the score of no evidence. Only doc_id and text are read.
    """

    def rate(block: TextBlock) -> dict:
        s = model.scores(block)
        return {"score": s, "predicted": (s >= model.rule.predict_at).astype(np.int32)}

    return map_texts(docs, rate, "score double, predicted int", fold=True)


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
