"""Numpy views of Arrow text columns: words, lines and position-independent span hashes.

Every Arrow-backed operator of this subpackage walks its input in blocks of a bounded number of
bytes and rows (`text_blocks`), so the memory of a task follows the block size and the longest single
text, never the partition. A word is a maximal run outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 4_096

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


class TextBlock:
    """The texts of one block. `rows` is the Arrow slice they came with."""

    def __init__(self, texts: pa.Array, rows: pa.RecordBatch | None = None, fold: bool = False):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.rows, self.n = rows, len(texts)
        if self.n:
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64)
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        else:
            at, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.texts, self.at, self.data = texts, at - at[0], _FOLD[data] if fold else data

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, starts, "right") - 1

    @cached_property
    def _sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_P, len(self.data)), out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans that depend only on the spans' bytes."""
        rolled = (self._sums[ends] - self._sums[starts]) * _power(_P_INV, len(self.data) + 1)[starts]
        return mix(rolled + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    @cached_property
    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[edges] = inside[edges]
        edges = self.at[1:][self.at[:-1] < self.at[1:]] - 1
        last[edges] = inside[edges]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def word_doc(self) -> np.ndarray:
        return self.doc_of(self.word_spans[0])

    @cached_property
    def word_at(self) -> np.ndarray:
        """Index of each text's first word; one more entry for the end."""
        return np.searchsorted(self.word_spans[0], self.at)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.word_spans)

    @cached_property
    def char_starts(self) -> np.ndarray:
        """Byte positions at which code points start."""
        return np.flatnonzero((self.data & 0xC0) != 0x80)

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of every run of k words; texts of 1 to k-1 words give one of all words if `short`."""
        words, doc, n = self.word_hash, self.word_doc, len(self.word_hash)
        if n >= k:
            full = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            h = np.zeros(len(full), np.uint64)
            for j in range(k):
                h = mix(h + words[full + j] + _U(j + 1))
            docs = doc[full]
        else:
            h, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if short:
            few = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
            if len(few):
                extra = np.zeros(len(few), np.uint64)
                for j in range(k - 1):
                    has = self.n_words[few] > j
                    extra[has] = mix(extra[has] + words[self.word_at[few[has]] + j] + _U(j + 1))
                docs, h = np.concatenate([docs, few]), np.concatenate([h, mix(extra + _U(k))])
                order = np.argsort(docs, kind="stable")
                docs, h = docs[order], h[order]
        return docs, h

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of every run of `size` code points, white space included."""
        at = np.append(self.char_starts, len(self.data))
        doc = self.doc_of(at[:-1])
        n = len(doc) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return doc[whole], self.hashes(at[whole], at[whole + size])

    def sums(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=self.n)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", fold: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """Slices of the batches with at most `block_bytes` of text and BLOCK_ROWS rows each, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = min(lo + BLOCK_ROWS, max(lo + 1, int(np.searchsorted(ends, base + block_bytes, "right"))))
            rows = batch.slice(lo, hi - lo)
            yield TextBlock(rows.column(column), rows, fold)
            lo = hi


def batch_of(columns: dict[str, pa.Array | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(schema.field(k).type) if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def map_texts(docs, fn, ddl: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", fold: bool = False, carry_text: bool = False):
    """`docs` with `fn(block) -> {column: values}` applied to every text, one output row per input row.

    Only `keep` and `text` are read. `ddl` names the columns that `fn` returns. `carry_text` returns the texts too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    chosen = docs.select(*keep, text)
    kept = (*keep, text) if carry_text else keep
    schema = StructType([*(chosen.schema[k] for k in kept), *StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for block in text_blocks(batches, text, fold):
            yield batch_of({k: block.rows.column(k) for k in kept} | fn(block), arrow)

    return chosen.mapInArrow(run, schema)
