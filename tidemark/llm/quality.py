"""Quality rules by compression bands.

zstandard ratios (raw bytes / compressed bytes) of the whole text and of its fixed-size chunks are
held against limits that depend on length: above the upper limit a text repeats itself, below the
lower one it is noise. Short texts get wider limits because a frame's fixed cost weighs on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.blocks import TextBlock, map_texts


@dataclass(frozen=True)
class Bands:
    """`whole`: (up to this many bytes, least ratio, greatest ratio), ascending. `chunk`: the limits of
    every full chunk of `chunk_bytes`, and of one more that ends with the text if full ones leave a rest; more than `bad_share` of chunks outside reject the text."""

    whole: tuple[tuple[float, float, float], ...] = (
        (100, 0.30, 2.5),
        (300, 0.60, 3.0),
        (1_000, 1.00, 4.0),
        (3_000, 1.15, 5.0),
        (10_000, 1.25, 6.0),
        (float("inf"), 1.30, 7.0),
    )
    chunk_bytes: int = 2_048
    chunk: tuple[float, float] = (1.10, 5.0)
    bad_share: float = 0.25
    level: int = 3


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(block: TextBlock) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-window counts of every text."""
    starts, ends = block.word_spans
    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    word_chars = block.sums(block.word_doc, chars[ends] - chars[starts]).astype(np.int64)
    symbols = block.sums(block.doc_of(np.flatnonzero(_SYMBOL[block.data])))

    breaks = np.flatnonzero(block.data == 10)
    line_starts = np.unique(np.concatenate([block.at[:-1][block.at[:-1] < block.at[1:]], breaks + 1]))
    line_starts = line_starts[line_starts < len(block.data)]
    next_break = np.append(breaks, len(block.data))[np.searchsorted(breaks, line_starts)]
    line_ends = np.minimum(next_break, block.at[block.doc_of(line_starts) + 1])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    doc = block.doc_of(line_starts)
    lines = np.empty(len(doc), [("doc", np.int64), ("hash", np.uint64)])
    lines["doc"], lines["hash"] = doc, block.hashes(line_starts, line_ends)
    once = np.unique(lines)["doc"]

    at, windows = _windows(block)
    order = np.lexsort((windows, block.word_doc[at]))
    at, windows = at[order], windows[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (windows[1:] == windows[:-1]) & (block.word_doc[at[1:]] == block.word_doc[at[:-1]])
    twice = at[same[:-1] | same[1:]]
    inside = np.zeros(len(block.word_doc) + 2, bool)
    for j in range(3):
        inside[twice + j] = True
    return {
        "n_words": block.n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": block.sums(doc) - block.sums(once),
        "n_repeat_words": block.sums(block.word_doc[inside[: len(block.word_doc)]]),
    }


def _windows(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    n, doc = len(block.word_doc), block.word_doc
    at = np.flatnonzero(doc[: max(n - 2, 0)] == doc[2:])
    return at, block.shingles(3, short=False)[1]


def ratios(block: TextBlock, bands: Bands) -> dict[str, np.ndarray]:
    """Compression ratio of every text (0 if empty) and its chunks outside the chunk band."""
    packer = zstandard.ZstdCompressor(level=bands.level)
    data, size = memoryview(block.data.tobytes()), bands.chunk_bytes
    whole, bad, chunks = np.zeros(block.n), np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    for i in range(block.n):
        lo, hi = int(block.at[i]), int(block.at[i + 1])
        if hi > lo:
            whole[i] = (hi - lo) / len(packer.compress(data[lo:hi]))
        if hi - lo >= size:
            starts = [*range(lo, hi - size, size), hi - size]
            own = [size / len(packer.compress(data[p : p + size])) for p in starts]
            chunks[i] = len(own)
            bad[i] = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in own)
    return {"ratio": whole, "n_chunks": chunks, "n_bad_chunks": bad}


def verdict(sizes: np.ndarray, found: dict[str, np.ndarray], bands: Bands) -> np.ndarray:
    band = np.searchsorted([w[0] for w in bands.whole], sizes)
    least, most = (np.array([w[k] for w in bands.whole])[band] for k in (1, 2))
    fits = (found["ratio"] >= least) & (found["ratio"] <= most)
    return fits & (found["n_bad_chunks"] <= bands.bad_share * np.maximum(found["n_chunks"], 1)) & (sizes > 0)


def compression_bands(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, ratios and verdict of every document.

    One row per row of `docs`, whose `doc_id` is carried as it is (null, repeated or not). A null or
    empty text has no words, ratio 0 and is not kept. Columns other than doc_id and text are not read.
    """

    def rate(block: TextBlock) -> dict[str, np.ndarray]:
        out, found = counts(block), ratios(block, bands)
        n = out["n_words"]
        failed = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
        return out | found | {"base_failed": failed, "kept": ~failed & verdict(np.diff(block.at), found, bands)}

    return map_texts(
        docs,
        rate,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean",
    )
