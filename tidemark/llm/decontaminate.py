"""Benchmark decontamination: SimHash windows sized by the item, multi-index Hamming blocks, exact weighted-shingle similarity.

Windows. The fingerprint of a window is the 64-bit SimHash of its words, from running sums. Whole items of very many lengths would
need a pass over the text for each length, so an item is cut into disjoint windows of one size, from a ladder with steps of
about the square root of two. With m five-word shingles, a run at the threshold t loses at most m (1 - t) / (1 + t) of them, or up to m (1 - t) where a text's end cuts it short. A changed
word costs five shingles, or fewer within four words of an end, so windows leave these free; a change of two words costs six and
touches two windows at the most. The size is the greatest at which an item has more windows than its loss can touch, so that one of them at least stands
in the run as it is. That is certain for changed, inserted and deleted words; only runs that shuffle or repeat an item's shingles can pass by, if no window
comes within the radius.

Search. Two fingerprints within radius 7 differ in at most one bit in one of four 16-bit blocks, so tables of all block values
within one bit of an item's find every pair within the radius. A hit places the item in the text.

Decision. The weighted Jaccard similarity of the item's and the run's shingles, with their counts, of the best run that holds a hit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, batch_of, map_texts, mix, text_blocks
from tidemark.llm.shared import unused

_U = np.uint64
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 2 * BLOCKS - 1
#: Words whose running sums are held at once.
STRETCH = 1 << 15


@dataclass(frozen=True)
class LeakRule:
    """`windows_at_once` bounds what is sent to the executors, at about 600 bytes a window and 8 a shingle; more items are searched for in further passes."""

    words: int = 5
    similarity: float = 0.8
    least_window: int = 8
    most_window: int = 32
    windows_at_once: int = 60_000


def windows(n: int, rule: LeakRule) -> tuple[int, list[int]]:
    """(size, offsets) of the windows of an item of n words: the greatest size of the ladder at which no loss that the threshold allows touches all windows."""
    m, t = n - rule.words + 1, rule.similarity
    most = max(0, int(m * (1 - t) + 1e-9))
    edge = min(rule.words - 1, most)

    def touched(size: int) -> int:
        worst = 0
        for lost in range(most + 1):
            rest = max(0, int((m * (1 - t) - lost) / (1 + t) + 1e-9)) if lost else int(m * (1 - t) / (1 + t) + 1e-9)
            inside = 2 * (rest // (rule.words + 1)) + (rest % (rule.words + 1) == rule.words)
            worst = max(worst, inside - (-max(0, lost - edge) // size))
        return worst

    ladder = [int(rule.least_window * 2 ** (k / 2)) for k in range(99) if rule.least_window * 2 ** (k / 2) <= rule.most_window]
    for size in reversed([*range(1, rule.least_window), *ladder]):
        if (n - 2 * edge) // size > (touched(size) if m > 0 else 0):
            return size, [edge + k * size for k in range((n - 2 * edge) // size)]
    raise ValueError("an item has a word at least")


def fingerprints(words: np.ndarray, size: int, ones: np.ndarray | None = None) -> np.ndarray:
    """SimHash of every run of `size` words; a bit is set if more than half of the words set it."""
    ones = running_ones(words) if ones is None else ones
    return np.packbits((ones[size:] - ones[:-size]) > np.uint16(size // 2), axis=1).view(np.uint64).reshape(-1)


def running_ones(words: np.ndarray) -> np.ndarray:
    """(words + 1, 64) counts of set bits so far, modulo 2**16; windows are shorter."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=out[1:])
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, or the one of all words if there are fewer."""
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = mix(h + words[j : len(words) - k + 1 + j] + _U(j + 1))
    return h


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], rule: LeakRule):
        self.rule, self.ids, self.length, self.bags = rule, [], [], []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = TextBlock(pa.array([text], pa.string()), fold=True).word_hash
            if not len(words):
                continue
            own = len(self.ids)
            self.ids.append(item_id)
            self.length.append(len(words))
            self.bags.append(Counter(shingle_hashes(words, rule.words).tolist()))
            size, offsets = windows(len(words), rule)
            prints = fingerprints(words, size)
            for at in offsets:
                found.setdefault(size, []).append((int(prints[at]), own, at))
        self.sizes = {size: self._tables(rows) for size, rows in sorted(found.items())}

    def least(self, item: int) -> int:
        """Shingles that a run shares with the item at the least if it reaches the threshold."""
        return math.ceil(self.rule.similarity * self.bags[item].total() - 1e-9)

    @staticmethod
    def _tables(found: list[tuple[int, int, int]]):
        prints = np.array([f[0] for f in found], np.uint64)
        item, offset = np.array([f[1] for f in found]), np.array([f[2] for f in found])
        flips = np.append(_U(1) << np.arange(BLOCK_BITS, dtype=np.uint64), _U(0))
        tables = []
        for b in range(BLOCKS):
            value = (((prints >> _U(b * BLOCK_BITS)) & _U(0xFFFF))[:, None] ^ flips[None, :]).astype(np.int64)
            which = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(value.reshape(-1), kind="stable")
            first = np.searchsorted(value.reshape(-1)[order], np.arange((1 << BLOCK_BITS) + 1))
            tables.append((np.diff(first) > 0, first, which[order]))
        return prints, item, offset, tables

    def _near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, window of an item, distance) of all pairs within the radius."""
        own, _, _, tables = self.sizes[size]
        found = []
        for b, (some, first, which) in enumerate(tables):
            value = prints.view(np.uint16).reshape(-1, BLOCKS)[:, b]
            at = np.flatnonzero(some[value])
            lo = first[value[at]]
            n = first[value[at].astype(np.int64) + 1] - lo
            pos = np.repeat(at, n)
            window = which[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            far = np.bitwise_count(prints[pos] ^ own[window])
            close = far <= RADIUS
            found.append((pos[close] * len(own) + window[close], far[close]))
        code, at = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        return code // len(own), code % len(own), np.concatenate([f[1] for f in found])[at]

    def hits(self, block: TextBlock) -> Iterator[tuple[int, int, int, float]]:
        """(text index, item number, first word in the text, similarity), the best place of each pair at or above the threshold."""
        words, doc, n = block.word_hash, block.word_doc, len(block.word_hash)
        places: dict[tuple[int, int], set[int]] = {}
        longest = max(self.sizes, default=0)
        for lo in range(0, n, STRETCH):
            part = words[lo : lo + STRETCH + longest]
            ones = running_ones(part)
            for size, (_, item, offset, _) in self.sizes.items():
                if len(part) < size:
                    continue
                at, window, _ = self._near(fingerprints(part, size, ones)[:STRETCH], size)
                at = at + lo
                inside = doc[at] == doc[at + size - 1]
                for p, w in zip(at[inside].tolist(), window[inside].tolist(), strict=True):
                    places.setdefault((int(doc[p]), int(item[w])), set()).update((p, p + max(0, size - self.rule.words)))
        shingles = shingle_hashes(words, self.rule.words) if n >= self.rule.words else np.zeros(0, np.uint64)
        for (d, i), found in sorted(places.items()):
            lo, hi = int(block.word_at[d]), int(block.word_at[d + 1])
            if self.length[i] < self.rule.words or hi - lo < self.rule.words:
                best = max((self._similar(words[p : min(hi, p + self.length[i])], i), lo - p) for p in found)
            else:
                last = hi - lo - self.rule.words
                best = self._best(shingles[lo : lo + last + 1], sorted({min(p - lo, last) for p in found}), i)
            if best[0] >= self.rule.similarity:
                yield d, i, -best[1], best[0]

    def _best(self, shingles: np.ndarray, at: list[int], item: int) -> tuple[float, int]:
        """(similarity, -first word) of the best of all runs that hold one of the shingles at `at`, the first of equals; runs are cut at the text's ends."""
        bag, m, least = self.bags[item], self.bags[item].total(), self.least(item)
        best = (0.0, 0)
        for lo, hi in _merged(at, m):
            part = shingles[max(lo, 0) : hi + m].tolist()
            if sum(h in bag for h in part) < least:
                continue
            held: Counter = Counter()
            shared = 0
            for end in range(max(lo, 0), hi + m):
                start = end - m
                if end < len(shingles):
                    h = part[end - max(lo, 0)]
                    if h in bag:
                        shared += held[h] < bag[h]
                        held[h] += 1
                if start >= max(lo, 0):
                    h = part[start - max(lo, 0)]
                    if h in bag:
                        held[h] -= 1
                        shared -= held[h] < bag[h]
                if shared >= least:
                    first = max(start + 1, 0)
                    best = max(best, (shared / (min(end + 1, len(shingles)) - first + m - shared), -first))
        return best

    def _similar(self, words: np.ndarray, item: int) -> float:
        here, own = Counter(shingle_hashes(words, self.rule.words).tolist()), self.bags[item]
        least = sum(min(c, own[h]) for h, c in here.items() if h in own)
        return least / (sum(here.values()) + sum(own.values()) - least)


def _merged(at: list[int], m: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of the starts of all runs of m shingles that hold one at `at` (ascending)."""
    out: list[tuple[int, int]] = []
    for p in at:
        if out and p - m + 1 <= out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p - m + 1, p))
    return out


def _indexes(items: DataFrame, rule: LeakRule) -> Iterator[ItemIndex]:
    """Indexes of all items, about `windows_at_once` windows in each."""
    named = items.select(F.col("item_id"), F.col("text")).filter(F.col("text").isNotNull()).distinct()
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    total = named.agg(F.sum(1 + F.floor(words / (rule.most_window // 2)))).first()[0] or 0
    parts = max(1, -(-total // rule.windows_at_once))
    for k in range(parts):
        rows = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield ItemIndex([(r["item_id"], r["text"]) for r in rows], rule)


def find_leaks(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """doc_id, item_id, word_start, n_words, similarity: one row per row of `docs` and item of `items` (item_id, text) that it contains.

    A text contains an item if some run of as many words, or what the text's ends leave of one, has a shingle similarity of
    at least 0.8 with it; every such pair is found. A-Z count as a-z. Null texts and those without words contain nothing, and such items are in no text; items of fewer
    than five words are one shingle. Repeated rows of `docs` give rows of their own; ids may be null. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    fields = [docs.schema["doc_id"], StructField("item_id", items.schema["item_id"].dataType), *StructType.fromDDL("word_start long, n_words long, similarity double").fields]
    schema = StructType(fields)
    arrow, context, out = to_arrow_schema(schema), docs.sparkSession.sparkContext, None
    for index in _indexes(items, rule):
        sent = context.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            for block in text_blocks(batches, fold=True):
                rows = list(index.hits(block))
                if rows:
                    d, i, at, s = zip(*rows, strict=True)
                    yield batch_of({"doc_id": block.rows.column("doc_id").take(pa.array(d)), "item_id": [index.ids[x] for x in i], "word_start": list(at), "n_words": [index.length[x] for x in i], "similarity": list(s)}, arrow)

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The rows of `docs`, all columns, that contain no item."""
    columns, context, (verdict,) = docs.columns, docs.sparkSession.sparkContext, unused(docs, "clean")
    for index in _indexes(items, rule):
        sent = context.broadcast(index)

        def judge(block: TextBlock, sent=sent) -> dict:
            clean = np.ones(block.n, bool)
            clean[[d for d, *_ in sent.value.hits(block)]] = False
            return {verdict: clean}

        docs = map_texts(docs, judge, f"{verdict} boolean", keep=tuple(c for c in columns if c != "text"), fold=True, carry_text=True).filter(F.col(verdict)).select(*columns)
    return docs
