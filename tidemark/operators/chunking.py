"""Heading-aware chunking of markdown, one document to many chunks, without a shuffle.

A document is cut into pieces by one pattern. All else are runs over arrays: a unit ends where a piece that is no code
begins, chunks end where the running length of units passes the limit, and small chunks join the run of the chunk before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.text import LINE_BREAK

CHARS_PER_TOKEN, OVERLAP = 4, 0.15
#: A fenced block, closed or not; a heading; or lines of a paragraph, which another piece or a blank line ends.
_BLANK = r"[^\S\n]*"
_FENCE = rf"^{_BLANK}(?:`{{3}}|~{{3}})"
_HEADING = r"^\#{1,6}[^\S\n]+\S"
PIECE = re.compile(
    rf"^(?P<code>{_BLANK}(?P<mark>`{{3}}|~{{3}})[^\n]*(?:\n(?s:.*?)^{_BLANK}(?P=mark)[^\n]*$|(?s:.*)))"
    rf"|^(?P<level>\#{{1,6}})[^\S\n]+(?P<title>[^\n]*\S){_BLANK}$"
    rf"|(?P<text>(?:^(?!{_FENCE}|{_HEADING}){_BLANK}\S[^\n]*\n?)+)",
    re.MULTILINE,
)


def _runs(starts: np.ndarray, texts: list[str]) -> list[str]:
    """The texts of each run, a blank line between; a run begins where `starts` is set."""
    at = np.flatnonzero(starts)
    return ["\n\n".join(texts[i:j]) for i, j in zip(at, np.append(at[1:], len(texts)), strict=True)]


def _cuts(units: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the units of each chunk. It takes units while their length and two characters for each before the last one keep to
    `most`, and one at least; the next chunk begins with its last units that fit into the overlap."""
    length = np.append(0, np.cumsum([len(u) for u in units]))
    spaced = length + 2 * np.arange(len(length))
    first = end = 0
    while end < len(units):
        free = most + 2 + spaced[end] - (length[end] - length[first])
        end = max(end + 1, int(np.searchsorted(spaced, free, "right")) - 1)
        yield first, end
        first = max(first, int(np.searchsorted(length, length[end] - int(OVERLAP * most))))


def chunk(text: str | None, target_tokens: int = 500, merge_tokens: int = 60) -> list[tuple[str, str]]:
    """(heading path, content) of a document's chunks."""
    pieces = list(PIECE.finditer(LINE_BREAK.sub("\n", text or "").removesuffix("\n")))
    opened = accumulate(((len(p["level"]), p["title"]) for p in pieces if p["level"]), lambda path, new: (*(x for x in path if x[0] < new[0]), new), initial=())
    paths = [" > ".join(title for _, title in path) for path in opened]
    heading = np.cumsum([bool(p["level"]) for p in pieces])
    body = [(int(h), p) for h, p in zip(heading, pieces, strict=True) if not p["level"]]
    if not body:
        return []
    section = np.array([h for h, _ in body])
    opens = np.append(True, section[1:] != section[:-1])
    begins = opens | np.array([p["code"] is None for _, p in body])
    units = _runs(begins, [p["code"] or p["text"].strip() for _, p in body])
    of_unit, found = section[begins], []
    for at in np.unique(of_unit):
        own = units[np.searchsorted(of_unit, at) : np.searchsorted(of_unit, at, "right")]
        found += [(paths[at], "\n\n".join(own[i:j])) for i, j in _cuts(own, target_tokens * CHARS_PER_TOKEN)]
    alone = np.array([len(content) for _, content in found]) >= merge_tokens * CHARS_PER_TOKEN
    alone[0] = True
    return list(zip((path for (path, _), own in zip(found, alone, strict=True) if own), _runs(alone, [content for _, content in found]), strict=True))


def chunk_documents(docs: DataFrame, target_tokens: int = 500, merge_tokens: int = 60) -> DataFrame:
    """(doc_key, source_url, doc_version, chunk_no, heading_path, content) from docs (doc_key, text, source_url, doc_version)."""
    kept, names = ("doc_key", "source_url", "doc_version"), ["doc_key", "source_url", "doc_version", "chunk_no", "heading_path", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [chunk(t, target_tokens, merge_tokens) for t in part.column("text").to_pylist()]
                doc = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                number = pa.array([n for f in found for n in range(len(f))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(pa.string()).take(doc) for c in kept), number, *(pa.array([row[k] for f in found for row in f], pa.string()) for k in (0, 1))], names=names)

    return docs.select(*kept, "text").mapInArrow(run, "doc_key string, source_url string, doc_version string, chunk_no int, heading_path string, content string")
