"""Cross-tokenizer alignment by tokenizer spans: where tokens of a byte-level tokenizer (A) and of a piece tokenizer (B) end together.

Both libraries tell which characters a token covers. These spans are coarse cuts: they don't say where a token ends that is a part of a character, such as a byte of
a multibyte character (A) or a byte-fallback token (B), which share a span or have an empty one. Such tokens are refined by the bytes that they decode to,
counted from the last coarse cut. A cut where tokens of both end closes a group.

Neither tokenizer joins anything over a single space between two visible characters, which a model's vocabulary and pre-tokenizer must confirm when it is loaded. Texts
are taken apart there, and parts, which repeat a lot, are aligned once per worker, all new ones of a block together.

How often two ids are linked is counted over all documents. Two tokens that end together end with the same bytes, so one's bytes end with the other's:
the pairs that can occur follow from the vocabularies, and a table of all their counts has a bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, map_texts
from tidemark.llm.bytelevel import ByteLevel
from tidemark.llm.shared import fresh_folder

MARK = "▁"
APART = re.compile(r"(?<=\S) (?=\S)")
WHOLE = re.compile(r"(?!)")
#: Parts, in each of two generations, that a worker remembers at most, and the longest of them; forgetting changes no result.
PARTS, PART_CHARS = 300_000, 32
#: Low bits of a packed pair of token counts.
HALF = 40


def refined(ends: np.ndarray, coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse ones as they are, others by the decoded bytes since the last coarse one (or the beginning)."""
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(ends)), -1))
    base = np.where(last >= 0, ends[last] - decoded[last], 0) if len(ends) else decoded
    return np.where(coarse, ends, base + decoded)


#: A part's token counts, packed, its links' numbers and its groups; None where its tokens don't give its bytes back.
Part = tuple[int, bytes, str] | None


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        byte_side = ByteLevel(a_path)
        self.a, self.a_raw = byte_side.library, byte_side.raw
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        inside = any(y == MARK != x for p in pieces for x, y in zip(p, p[1:], strict=False))
        self.apart = APART if byte_side.cuts_at_spaces and not inside else WHOLE
        self.sizes = [np.array([len(r) for r in raw], np.int64) for raw in (self.a_raw, self.b_raw)]
        self.at = [np.concatenate([[0], np.cumsum(s)]) for s in self.sizes]
        self.all = [np.frombuffer(b"".join(raw), np.uint8) for raw in (self.a_raw, self.b_raw)]
        self.names = [list(map(str, range(len(raw)))) for raw in (self.a_raw, self.b_raw)]
        self.links = self._possible()
        self.known: dict[str, Part] = {}
        self.older: dict[str, Part] = {}

    def _possible(self) -> np.ndarray:
        """All (A id, B id) of which one's bytes end with the other's, as sorted numbers A * size of B + B."""
        size, out = len(self.b_raw), set()
        by_bytes: list[dict[bytes, list[int]]] = []
        for raw in (self.a_raw, self.b_raw):
            of: dict[bytes, list[int]] = {}
            for i, r in enumerate(raw):
                of.setdefault(r, []).append(i)
            of.pop(b"", None)
            by_bytes.append(of)
        for a, r in enumerate(self.a_raw):
            out.update(a * size + b for k in range(len(r)) for b in by_bytes[1].get(r[k:], ()))
        for b, r in enumerate(self.b_raw):
            out.update(a * size + b for k in range(len(r)) for a in by_bytes[0].get(r[k:], ()))
        return np.array(sorted(out), np.int64)

    def _joined(self, side: int, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes, joined, are those of their text."""
        sizes = self.sizes[side][ids]
        total = np.bincount(np.repeat(np.arange(len(counts)), counts), sizes, len(counts)).astype(np.int64)
        good = total == np.diff(at)
        ends = np.cumsum(sizes)
        raw = self.all[side][np.arange(sizes.sum()) + np.repeat(self.at[side][ids] - ends + sizes, sizes)]
        kept = np.repeat(good, total)
        wanted = np.repeat(good, np.diff(at))
        of = np.repeat(np.arange(len(counts))[good], total[good])
        good[np.unique(of[raw[kept] != data[wanted]])] = False
        return good

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A, their byte ends, ids of B, their byte ends, tokens of A and of B in each text, byte beginnings of the texts, which of them both tokenizers give back) of texts, each behind a space; bytes count through all of them."""
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        char_at = np.searchsorted(chars, at[:-1])
        flat = lambda lists, n: np.fromiter(chain.from_iterable(lists), np.int64, n)

        found = self.a.encode_batch(spaced, add_special_tokens=False)
        n_a = np.array([len(f) for f in found])
        a_ids = flat((f.ids for f in found), n_a.sum())
        spans = flat(chain.from_iterable(f.offsets for f in found), 2 * n_a.sum()).reshape(-1, 2) + np.repeat(char_at, n_a)[:, None]
        last = np.zeros(len(a_ids) + 1, bool)
        last[np.cumsum(n_a)] = True
        follows = np.append(spans[1:, 0], 0)
        a_ends = refined(chars[np.minimum(spans[:, 1], len(chars) - 1)], last[1:] | (follows >= spans[:, 1]), self.sizes[0][a_ids])

        found = self.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)
        n_b = np.array([len(f["ids"]) for f in found])
        b_ids = flat((f["ids"] for f in found), n_b.sum())
        spans = flat(chain.from_iterable(f["offsets"] for f in found), 2 * n_b.sum()).reshape(-1, 2) + np.repeat(at[:-1] + 1, n_b)[:, None]
        b_ends = refined(spans[:, 1], spans[:, 1] > spans[:, 0], self.sizes[1][b_ids])
        return a_ids, a_ends, b_ids, b_ends, n_a, n_b, at, self._joined(0, a_ids, n_a, data, at) & self._joined(1, b_ids, n_b, data, at)

    def align(self, parts: list[str]) -> list[Part]:
        """(token counts, packed; link numbers as unsigned 32-bit integers; groups as text) of every part, each behind a space; None where joined tokens differ from it.

        Parts that begin and end with a visible character are encoded as one text, in which they stand apart as in their own; others one by one.
        """
        visible = [k for k, p in enumerate(parts) if not p[0].isspace() and not p[-1].isspace() and MARK not in p] if self.apart is APART else []
        out: list[Part] = [None] * len(parts)
        alone = sorted(set(range(len(parts))) - set(visible))
        if len(visible) > 1:
            found = self._split([" ".join(parts[k] for k in visible)], [parts[k] for k in visible])
            if found is None:
                alone = [*alone, *visible]
            else:
                for k, got in zip(visible, found, strict=True):
                    out[k] = got
        else:
            alone = [*alone, *visible]
        if alone:
            for k, got in zip(alone, self._split([parts[k] for k in alone], [parts[k] for k in alone]), strict=True):
                out[k] = got
        return out

    def _split(self, texts: list[str], parts: list[str]) -> list[Part] | None:
        """What `align` gives for parts that are the texts, or stand together in one text; None if that text isn't given back."""
        a_ids, a_ends, b_ids, b_ends, n_a, n_b, at, good = self._tokens(texts)
        if len(texts) != len(parts):
            if not good[0]:
                return None
            ends, good = np.cumsum([len(p.encode()) + 1 for p in parts]), np.ones(len(parts), bool)
            n_a, n_b = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_ends, b_ends))
        a_at, b_at = np.cumsum(n_a), np.cumsum(n_b)
        ok_a, ok_b = np.flatnonzero(np.repeat(good, n_a)), np.flatnonzero(np.repeat(good, n_b))
        _, in_a, in_b = np.intersect1d(a_ends[ok_a], b_ends[ok_b], assume_unique=True, return_indices=True)
        in_a, in_b = ok_a[in_a], ok_b[in_b]
        number = np.searchsorted(self.links, a_ids[in_a] * len(self.b_raw) + b_ids[in_b]).astype("<u4").tobytes()
        first = np.searchsorted(in_a, np.append(0, a_at)).tolist()
        a_names, b_names = list(map(self.names[0].__getitem__, a_ids.tolist())), list(map(self.names[1].__getitem__, b_ids.tolist()))
        begins = np.repeat(np.arange(len(parts)), np.diff(first))
        a_from, b_from = np.append(0, in_a + 1)[:-1], np.append(0, in_b + 1)[:-1]
        a_from, b_from = np.maximum(a_from, (a_at - n_a)[begins]), np.maximum(b_from, (b_at - n_b)[begins])
        groups = [
            f"{a_names[a]}|{b_names[b]}" if a == a_to and b == b_to else ",".join(a_names[a : a_to + 1]) + "|" + ",".join(b_names[b : b_to + 1])
            for a, a_to, b, b_to in zip(a_from.tolist(), in_a.tolist(), b_from.tolist(), in_b.tolist(), strict=True)
        ]
        packed = ((n_a.astype(np.int64) << HALF) | n_b).tolist()
        return [(packed[k], number[4 * i : 4 * j], ";".join(groups[i:j])) if good[k] else None for k, (i, j) in enumerate(zip(first, first[1:], strict=False))]

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, str] | None]:
        """(tokens of A, tokens of B, link numbers, groups as text) of every text; None without tokens."""
        apart = [self.apart.split(t) if t else [] for t in texts]
        now: dict[str, Part] = {}
        new = []
        known, older = self.known, self.older
        for p in dict.fromkeys(chain.from_iterable(apart)):
            if p in known:
                now[p] = known[p]
            elif p in older:
                now[p] = older[p]
            else:
                new.append(p)
        now.update(zip(new, self.align(new) if new else [], strict=True))
        for parts in apart:
            got = [now[p] for p in parts]
            if not got or None in got:
                yield None
                continue
            counts, links, groups = zip(*got, strict=True)
            both = sum(counts)
            yield both >> HALF, both & (1 << HALF) - 1, b"".join(links), ";".join(groups)
        if len(self.known) + len(now) > PARTS:
            self.known, self.older = {}, self.known
        self.known.update((p, got) for p, got in now.items() if len(p) <= PART_CHARS)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align_texts(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """The groups of every document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, and groups.

    `groups` is a text such as `a1,a2|b1;a3|b2,b3`, the ids of A and B in each group in order; `links` has the number of each link's id pair (`Aligner.links`) as little-endian
    unsigned 32-bit integers, in the order of the groups. A text that is null or empty, or whose tokens of A or B don't give its bytes back behind a space, has no tokens, zeros, and an empty
    digest. One row per row of `docs`, whatever its doc_id; texts are aligned whole, and a very long one costs memory by its own length. Columns other than doc_id and text are not read.
    """

    def run(block: TextBlock) -> dict[str, list]:
        names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *["groups"] * with_groups)
        rows = []
        for found in aligner(a_path, b_path).aligned(block.texts.to_pylist()):
            n_a, n_b, links, groups = found or (0, 0, b"", "")
            n = len(links) // 4
            rows.append((n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest() if found else "", links, groups))
        return {name: list(column) for name, column in zip(names, zip(*rows, strict=True), strict=False)}

    return map_texts(docs, run, f"n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary{', groups string' * with_groups}")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n): how often each id pair is linked in all documents. A task counts into a table of all pairs that it meets; their rows are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            links = batch.column("links")
            ends = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1]
            more = np.bincount(np.frombuffer(links.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4")) if len(links) and ends[-1] > ends[0] else counts[:0]
            if len(more) > len(counts):
                counts = np.append(counts, np.zeros(len(more) - len(counts), np.int64))
            counts[: len(more)] += more
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["link", "n"])

    return aligned.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`aligned` with n_best, the links whose pair has the greatest count of its B id's pairs, ties included, and count_sum, the sum of the links' counts.

    The counts that are sent to all tasks are those of the pairs that the vocabularies allow, some hundred thousand whatever the documents.
    """
    links = aligner(a_path, b_path).links
    counts = np.zeros(len(links), np.int64)
    found = link_counts(aligned).toArrow()
    counts[found.column("link").to_numpy()] = found.column("n").to_numpy()
    b_id = links % len(aligner(a_path, b_path).b_raw)
    most = np.zeros(b_id.max() + 1, np.int64)
    np.maximum.at(most, b_id, counts)
    sent = aligned.sparkSession.sparkContext.broadcast((counts, counts == most[b_id]))
    names = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            numbers = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("links")]
            scores = [pa.array([int(table[x].sum()) for x in numbers], pa.int64()) for table in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *scores], names=[*names, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in aligned.dtypes if c != "links")
    return aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def align_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """Aligned documents with the counts of their links over all of them. The alignment is written once, to the shared folder, and read for the counts and for the scores."""
    path = fresh_folder(docs.sparkSession, "aligned")
    align_texts(docs, a_path, b_path, with_groups).write.parquet(path)
    return score_links(docs.sparkSession.read.parquet(path), a_path, b_path)
