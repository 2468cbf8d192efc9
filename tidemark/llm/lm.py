"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words with A-Z as a-z, then one end a text. The commonest words and the end are classes of their
own; other words fall into a few rare classes by their shape. The log-bilinear model gives the class of the
next token from the two classes before it:

    s(w | c1, c2) = log p(w) + (A1[c1] + A2[c2]) . Q[w] + b[w],    P(w | c1, c2) = exp s / sum of exp s,

and a rare word has its smoothed share of its class, so that probabilities sum to 1 over all words with one unknown word per rare class.

Learning covers every training text. Spark counts words and class trigrams over the whole corpus; each
round of training sends the parameters to the partitions of the trigram table (dealt out by context), where
numpy takes noise-contrastive gradient steps on every trigram, weighted by its count, and averages what comes back.
Scoring makes one matrix product for the distinct contexts of a block. Counts of words outside a bounded head
come by a join on the word's 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, mix, text_blocks
from tidemark.llm.samples import fold
from tidemark.llm.shared import cut

END = int(mix(np.array([0xE4D], np.uint64)).view(np.int64)[0])
#: Shapes of rare words: (ends in a full stop, in another mark or none) times (all ASCII or not); the end has shape 0.
SHAPES = 6


@dataclass(frozen=True)
class LmRule:
    """`head` bounds the word counts, and `classes` the classes, that are sent to every task. In a round, a trigram of mean count is visited `draws` times.
    A training partition has about `part_tokens` tokens, however many the corpus and the cluster have."""

    classes: int = 800
    head: int = 200_000
    width: int = 32
    noise: int = 64
    rounds: int = 2
    batch: int = 1_024
    draws: int = 3
    part_tokens: int = 2_000_000
    rate: float = 0.05
    seed: int = 4


def shapes(block: TextBlock) -> np.ndarray:
    starts, ends = block.word_spans
    last = block.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    high = np.concatenate([[0], np.cumsum(block.data >= 128)])
    return (np.where(last == 46, 0, np.where(letter, 1, 2)) * 2 + (high[ends] > high[starts])).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n) of the whole table; the end of every text is a word."""

    def run(batches):
        for block in text_blocks(batches, fold=True):
            words, at, n = np.unique(block.word_hash.view(np.int64), return_index=True, return_counts=True)
            shape = shapes(block)[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words, END)), pa.array(np.append(shape, 0)), pa.array(np.append(n, block.n).astype(np.int64))], names=["word", "shape", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, shape long, n long")
    return rows.groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Head words by hash, their counts and classes, and the totals of all training tokens."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    rare_tokens: np.ndarray
    rare_types: np.ndarray
    common: int

    @property
    def size(self) -> int:
        return self.common + SHAPES

    def look_up(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count or -1 outside the head, hash) of every word of a block."""
        h = block.word_hash.view(np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        here = self.words[at] == h
        own = np.where(here, self.classes[at], -1)
        return np.where(own >= 0, own, self.common + shapes(block)), np.where(here, self.counts[at], -1), h

    def log_class(self) -> np.ndarray:
        mass = np.full(self.size, 0.5)
        own = self.classes >= 0
        mass[self.classes[own]] += self.counts[own]
        mass[self.common :] += self.rare_tokens
        return np.log(mass / mass.sum())

    def log10_rare(self) -> np.ndarray:
        return np.log10(self.rare_tokens + 0.5 * (self.rare_types + 1))


def vocabulary(counts: DataFrame, rule: LmRule) -> Vocabulary:
    shaped = {r["shape"]: (r["tokens"], r["types"]) for r in counts.groupBy("shape").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect()}
    top = counts.orderBy(F.desc("n"), "word").limit(rule.head).toArrow()
    words, n, shape = (top.column(c).to_numpy() for c in ("word", "n", "shape"))
    if END not in words:
        words, n, shape = np.append(words, END), np.append(n, 0), np.append(shape, 0)
    order = np.lexsort((words, -n, words != END))
    common = min(rule.classes, len(words))
    own = np.full(len(words), -1)
    own[order[:common]] = np.arange(common)
    tokens, types = (np.array([shaped.get(s, (0, 0))[k] for s in range(SHAPES)], np.int64) for k in (0, 1))
    rare_tokens, rare_types = tokens.copy(), types.copy()
    np.subtract.at(rare_tokens, shape[own >= 0], n[own >= 0])
    np.subtract.at(rare_types, shape[own >= 0], (n[own >= 0] > 0).astype(np.int64))
    by_hash = np.argsort(words)
    return Vocabulary(words[by_hash], n[by_hash], own[by_hash], int(tokens.sum()), int(types.sum()), rare_tokens, rare_types, common)


def sequences(block: TextBlock, classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, class before, class before that, text index) of every token; the end has class 0."""
    n = len(classes) + block.n
    ends = block.word_at[1:] + np.arange(block.n)
    token = np.zeros(n, np.int64)
    is_word = np.ones(n, bool)
    is_word[ends] = False
    token[is_word] = classes
    doc = np.repeat(np.arange(block.n), block.n_words + 1)
    one, two = np.full(n, start), np.full(n, start)
    one[1:] = np.where(doc[1:] == doc[:-1], token[:-1], start)
    two[2:] = np.where(doc[2:] == doc[:-2], token[:-2], start)
    return token, one, two, doc


def trigrams(docs: DataFrame, sent, size: int) -> DataFrame:
    """(context, word, n) of class trigrams over the whole table."""

    def run(batches):
        words = sent.value
        for block in text_blocks(batches, fold=True):
            w, one, two, _ = sequences(block, words.look_up(block)[0], size)
            code, n = np.unique((one * (size + 1) + two) * (size + 1) + w, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // (size + 1)), pa.array(code % (size + 1)), pa.array(n.astype(np.int64))], names=["context", "word", "n"])

    return docs.select("text").mapInArrow(run, "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """One matrix of `width + 1` columns: A1 and A2 for size + 1 contexts each, then Q and its bias for size words."""

    table: np.ndarray
    log_p: np.ndarray

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.log_p)
        return self.table[: n + 1, :-1], self.table[n + 1 : 2 * n + 2, :-1], self.table[2 * n + 2 :, :-1], self.table[2 * n + 2 :, -1]

    @classmethod
    def fresh(cls, log_p: np.ndarray, rule: LmRule) -> LogBilinear:
        table = np.random.default_rng(rule.seed).normal(0, 0.1, (3 * len(log_p) + 2, rule.width + 1))
        table[:, -1] = 0
        return cls(table, log_p)

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; the sum over all classes is taken once for each distinct context."""
        a1, a2, q, b = (x.astype(np.float32) for x in self.parts)
        log_p, n = self.log_p.astype(np.float32), len(self.log_p) + 1
        code, back = np.unique((one * n + two) * n + word, return_inverse=True)
        context, inner = np.unique(code // n, return_inverse=True)
        out = np.zeros(len(code))
        for lo in range(0, len(context), 2048):
            c = context[lo : lo + 2048]
            logits = (a1[c // n] + a2[c % n]) @ q.T + (b + log_p)
            top = logits.max(axis=1)
            z = top + np.log(np.exp(logits - top[:, None]).sum(axis=1, dtype=np.float64))
            i0, i1 = np.searchsorted(inner, [lo, lo + len(c)])
            out[i0:i1] = logits[inner[i0:i1] - lo, code[i0:i1] % n] - z[inner[i0:i1] - lo]
        return out[back] / np.log(10)


def visits(n: np.ndarray, unit: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight) of every step of one pass in random order: each row is there, its weights are at most 1 and sum to n / unit."""
    times = np.ceil(n / unit).astype(np.int64)
    at = rng.permutation(np.repeat(np.arange(len(n)), times))
    return at, (n / (times * unit))[at]


def contrast(model: LogBilinear, one: np.ndarray, two: np.ndarray, word: np.ndarray, n: np.ndarray, rng: np.random.Generator, rule: LmRule, seen: np.ndarray | None = None, unit: float | None = None, moved: np.ndarray | None = None) -> None:
    """Noise-contrastive steps on all trigrams, weighted by their counts. Noise comes from the class frequencies, which the model's score contains, so they cancel.

    `seen` holds the sums of squared slopes that scale the steps, and grows. `unit` is the count of a visit of weight 1; it must be
    the same for all batches of a table, so that every token of it counts alike. `moved` gathers, for each row of the table, the weight of the visits that moved it.
    """
    a1, a2, q, b = model.parts
    n_words = len(b)
    p = np.exp(model.log_p)
    slope, seen = np.zeros_like(model.table), np.full(model.table.shape, 1e-6) if seen is None else seen
    rows, weights = visits(n, n.mean() / rule.draws if unit is None else unit, rng)
    for lo in range(0, len(rows), rule.batch):
        at, weight = rows[lo : lo + rule.batch], weights[lo : lo + rule.batch]
        c1, c2, w = one[at], two[at], word[at]
        noise = rng.choice(n_words, size=rule.noise, p=p)
        r = a1[c1] + a2[c2]
        hit = weight * _logistic(np.log(rule.noise) - (r * q[w]).sum(axis=1) - b[w])
        miss = -weight[:, None] * _logistic(r @ q[noise].T + b[noise] - np.log(rule.noise))
        back = hit[:, None] * q[w] + miss @ q[noise]
        slope[:] = 0
        words = slope[2 * n_words + 2 :]
        _add_rows(words, w, np.column_stack([hit[:, None] * r, hit]))
        _add_rows(words, noise, np.column_stack([miss.T @ r, miss.sum(axis=0)]))
        _add_rows(slope[: n_words + 1, :-1], c1, back)
        _add_rows(slope[n_words + 1 : 2 * n_words + 2, :-1], c2, back)
        slope /= rule.batch
        if moved is not None:
            size = n_words + 1
            moved[:size] += np.bincount(c1, weight, size)
            moved[size : 2 * size] += np.bincount(c2, weight, size)
            moved[2 * size :] += np.bincount(w, weight, n_words) + np.bincount(noise, minlength=n_words) * (weight.sum() / rule.noise)
        seen += slope * slope
        model.table += rule.rate * slope / np.sqrt(seen)


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
    target[at[order[first]]] += np.add.reduceat(rows[order], first, axis=0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(grams: DataFrame, log_p: np.ndarray, tokens: int, rule: LmRule) -> LogBilinear:
    """A model after `rounds` passes over all rows of `grams`; merged parameters and the sizes of partitions return to the driver.

    A pass of its own over the partition with most tokens sets out the directions of the embeddings, since those of independent
    starts can't be averaged. In the `rounds` passes after it all partitions start alike. What comes back is merged row by row, each partition
    counting by the weight of its visits to that row, so that a row is not held back by partitions that never met it; a row that none met stays.
    """
    model, context = LogBilinear.fresh(log_p, rule), grams.sparkSession.sparkContext
    n = len(log_p) + 1
    dealt = cut(grams.repartition(max(1, -(-tokens // rule.part_tokens)), "context").sortWithinPartitions(F.xxhash64("context"), "context", "word"))
    sizes = dealt.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).collect()
    if not sizes:
        return model
    largest = max(sizes, key=lambda r: (r["tokens"], -r["part"]))["part"]
    unit = sum(r["tokens"] for r in sizes) / sum(r["rows"] for r in sizes) / rule.draws
    for turn in range(rule.rounds + 1):
        sent = context.broadcast(model)

        def run(batches, sent=sent, turn=turn):
            own, moved = None, np.zeros(len(sent.value.table))
            for batch in batches:
                if not batch.num_rows:
                    continue
                c, w, k = (batch.column(x).to_numpy() for x in ("context", "word", "n"))
                if own is None:
                    seen = np.full(sent.value.table.shape, 1e-6)
                    own, rng = LogBilinear(sent.value.table.copy(), sent.value.log_p), np.random.default_rng([rule.seed, turn, int(c[0])])
                contrast(own, c // n, c % n, w, k, rng, rule, seen, unit, moved)
            if own is not None:
                size = own.table.shape
                values = pa.ListArray.from_arrays(pa.array(np.arange(size[0] + 1) * size[1], pa.int32()), pa.array(own.table.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size[0])), values, pa.array(moved)], names=["row", "own", "moved"]).filter(pa.array(moved > 0))

        taken = dealt.filter(F.spark_partition_id() == largest) if turn == 0 else dealt
        trained = taken.mapInArrow(run, "row long, own array<double>, moved double")
        merged = trained.groupBy("row").agg(*((F.sum(F.col("own")[k] * F.col("moved")) / F.sum("moved")).alias(f"s{k}") for k in range(rule.width + 1)))
        got, table = merged.toArrow(), model.table.copy()
        table[got.column("row").to_numpy()] = np.column_stack([got.column(f"s{k}").to_numpy() for k in range(rule.width + 1)])
        model = LogBilinear(table, log_p)
        sent.unpersist()
    return model


def score_texts(docs: DataFrame, trains: Column, rule: LmRule = LmRule()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document, learnt from the rows where `trains` holds.

    Texts are read once for their scores; rows that repeat an id and its text are scored as one and counted.

    One row per row of `docs`, repeated or without an id or not. A null text counts as empty and has the
    end alone. Without a training row every word is unknown and train_tokens is 0. Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    counts = cut(word_counts(docs.filter(trains)))
    words = vocabulary(counts, rule)
    sent = context.broadcast(words)
    model = context.broadcast(train(trigrams(docs.filter(trains), sent, words.size), words.log_class(), words.tokens, rule))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))

    def head(block: TextBlock, own: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """n_tokens, known, base and model of every text, as far as the head of the vocabulary tells."""
        words = sent.value
        w, one, two, doc = sequences(block, own, words.size)
        ends = words.counts[words.words == END][0]
        inside = np.log10(np.maximum(n, 0) + 0.5)
        rare, here = own >= words.common, n >= 0
        share = np.where(rare, np.where(here, inside, 0.0) - words.log10_rare()[np.maximum(own - words.common, 0)], 0.0)
        known = block.sums(block.word_doc[n > 0]) + int(ends > 0)
        base = block.sums(block.word_doc[here], inside[here]) + np.log10(ends + 0.5)
        return [block.n_words + 1, known, base, block.sums(doc, model.value.log10(one, two, w)) + block.sums(block.word_doc, share)]

    def rows(batches):
        """A row of every text with what the head tells, and one of each word of it outside the head with its number there."""
        for block in text_blocks(batches, fold=True):
            own, n, h = sent.value.look_up(block)
            out = n < 0
            pairs = np.empty(int(out.sum()), [("doc", np.int64), ("word", np.int64)])
            pairs["doc"], pairs["word"] = block.word_doc[out], h[out]
            pairs, k = np.unique(pairs, return_counts=True)
            key, each = block.rows.column("key").to_numpy(), np.arange(block.n)
            doc = np.append(each, pairs["doc"])
            #: Texts have no word of their own; a hash of each spreads them over the join.
            word = np.append(mix(each.astype(np.uint64) + np.uint64(1) + key.view(np.uint64)).view(np.int64), pairs["word"])
            told = [pa.concat_arrays([pa.array(x, t), pa.nulls(len(pairs), t)]) for x, t in zip(head(block, own, n), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id").take(pa.array(doc)), pa.array(key[doc]), pa.array(word), pa.array(np.append(np.zeros(block.n, np.int64), k)), *told], names=["doc_id", "key", "word", "k", "n_tokens", "known", "base", "model"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    told = keyed.mapInArrow(rows, f"doc_id {id_type}, key long, word long, k long, n_tokens long, known long, base double, model double").join(counts.select("word", "n"), "word", "left")
    found = F.coalesce("n", F.lit(0))
    rest = (F.sum(F.when(F.col("k") > 0, F.col("k") * F.log10(found + 0.5)).otherwise(0.0)), F.sum(F.when((F.col("k") > 0) & (found > 0), F.col("k")).otherwise(0)))
    once = told.groupBy("doc_id", "key").agg(F.count("n_tokens").alias("copies"), *(F.max(c).alias(c) for c in ("n_tokens", "known", "base", "model")), *(x.alias(c) for x, c in zip(rest, ("rest", "rest_known"), strict=True)))
    each = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    more, space = F.col("rest") / F.col("copies"), F.lit(float(np.log10(words.tokens + 0.5 * (words.types + 1))))
    return each.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.col("rest_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * space).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 5) == 1, F.lit(True))
