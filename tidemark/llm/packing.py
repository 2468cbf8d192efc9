"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A piece is a document's ids with an end id, or a part of them where they are more than a sequence holds. What fits with what depends on lengths
alone, and there are at most `capacity` of these: pieces are counted by length, a plan is made of the counts, and each length's
pieces are dealt to the plan's places by their number. The plan first takes exact complements: what is left beside a piece is looked up in an index of the
sums of one, two and three lengths, and a combination is used as often as all of its lengths are there. What has no exact complement any more is packed best fit,
longest first. Plan and counts have a size that doesn't grow with the documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import text_blocks
from tidemark.llm.bytelevel import byte_level
from tidemark.llm.shared import cut, numbered


@dataclass(frozen=True)
class PackRule:
    capacity: int = 1_024
    end: int = 2


#: Shares of the capacity from which on a piece's gap is filled by pairs and triples.
FLOORS = (0, 1 / 2, 2 / 3, 3 / 4, 1)


class Sums:
    """Combinations of one, two and three lengths by their sum, of lengths that only get fewer."""

    def __init__(self, left: list[int]):
        self.left = left
        there = [n for n, count in enumerate(left) if count and n]
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for k, b in enumerate(there):
            for a in there[k:]:
                if a + b < len(left):
                    self.pairs.setdefault(a + b, []).append((a, b))
        for found in self.pairs.values():
            found.sort(reverse=True)  # the most even pair is at the end

    def enough(self, parts: tuple[int, ...]) -> bool:
        return all(self.left[n] >= k for n, k in Counter(parts).items())

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        """A pair of this sum that is there besides other parts."""
        found = self.pairs.get(total, [])
        while found and not self.enough(found[-1]):
            found.pop()
        return next((p for p in reversed(found) if self.enough((*beside, *p))), None)

    def filling(self, gap: int, beside: int, most: int = 3) -> tuple[int, ...] | None:
        """At most one or three lengths that fill the gap beside a piece, all there at once: as few as possible."""
        if gap == 0:
            return ()
        if self.enough((beside, gap)):
            return (gap,)
        if most == 1:
            return None
        if found := self.pair(gap, (beside,)):
            return found
        for c in range(gap // 3, 0, -1):
            if self.left[c] and (found := self.pair(gap - c, (beside, c))):
                return (*found, c)
        return None


def exact_sequences(left: list[int], floor: float = 0) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, times)] of full sequences, longest pieces first; takes what it uses from `left`, the number of pieces by length. Beside pieces up to `floor` single complements only."""
    capacity, sums, out = len(left) - 1, Sums(left), []
    for longest in range(capacity, 0, -1):
        while left[longest] and (rest := sums.filling(capacity - longest, longest, 3 if longest > floor else 1)) is not None:
            need = Counter((longest, *rest))
            times = min(left[n] // k for n, k in need.items())
            for n, k in need.items():
                left[n] -= k * times
            out.append(((longest, *rest), times))
    return out


def residual_sequences(left: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, times)] by best fit, longest pieces first, of all that is in `left`; sequences with the same lengths stay together."""
    capacity = len(left) - 1
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(parts: tuple[int, ...], times: int) -> None:
        room = capacity - sum(parts)
        if not by_room.setdefault(room, []):
            insort(rooms, room)
        by_room[room].append((parts, times))

    for n in range(capacity, 0, -1):
        while left[n]:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                parts, times = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    rooms.pop(at)
                used = min(times, left[n])
                if used < times:
                    put(parts, times - used)
                put((*parts, n), used)
            else:
                each = capacity // n
                used = left[n] // each
                for parts, times in (((n,) * each, used), ((n,) * (left[n] % each), 1)):
                    if parts and times:
                        put(parts, times)
                used = left[n]
            left[n] -= used
    return [one for room in sorted(by_room) for one in by_room[room]]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence's pieces, number of such sequences)] that use every piece once.

    Pairs and triples use up short pieces, which best fit may need more; so plans that take them beside all pieces, and beside long ones only, are made of the same counts,
    and the one of fewest sequences is taken, of several the one with most exact ones.
    """
    plans = []
    for share in FLOORS:
        left = [counts.get(n, 0) for n in range(capacity + 1)]
        exact = exact_sequences(left, share * capacity)
        plan = exact + residual_sequences(left)
        plans.append((sum(times for _, times in plan), -sum(times for _, times in exact), plan))
    return min(plans, key=lambda p: p[:2])[2]


class Places:
    """Where the k-th piece of a length goes: runs of pieces that share a place in consecutive sequences."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        runs, used, first = [], Counter(), 0
        for parts, times in plan:
            offset = 0
            for n in parts:
                runs.append((n, used[n], first, offset))
                used[n] += times
                offset += n
            first += times
        self.sequences = first
        table = np.array(sorted(runs), np.int64).reshape(-1, 4)
        self.key, self.start, self.first, self.offset = self._key(table[:, 0], table[:, 1]), table[:, 1], table[:, 2], table[:, 3]

    @staticmethod
    def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length << 48) | number

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number from 0 among those of the length."""
        run = np.searchsorted(self.key, self._key(length, number), "right") - 1
        return self.first[run] + number - self.start[run], self.offset[run]


def token_pieces(docs: DataFrame, tokenizer: str, rule: PackRule = PackRule(), with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and the end id, cut only if more than the capacity. Then all pieces but the first are full."""
    chosen, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([rule.end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(tokenizer)
        for block in text_blocks(batches):
            of, rows = [], []
            for row, text in enumerate(block.texts.to_pylist()):
                ids = np.concatenate([coder.encode(text), end])
                at, first = 0, len(ids) % rule.capacity or rule.capacity
                for piece, upto in enumerate(range(first, len(ids) + 1, rule.capacity)):
                    part = ids[at:upto].tobytes()
                    of.append(row)
                    rows.append((piece, at, upto - at, zlib.crc32(part), part))
                    at = upto
            columns = [pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id").take(pa.array(of)), *columns[: len(names) - 1]], names=names)

    return chosen.mapInArrow(run, f"doc_id {kind.simpleString()}, piece long, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, rule: PackRule = PackRule(), with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences are filled from 0 without gaps.

    `tokenizer` is the path of a byte-level file on every machine. A null text is an empty one and gives its end id alone; repeated rows and rows without an id
    are packed like others; a very long text is encoded whole and gives as many pieces as it needs. Pieces of one length stand in the order of doc_id and piece, and ties don't
    matter as they are alike in all that a place depends on. An empty table gives no row. Columns other than doc_id and text are not read.
    """
    pieces = cut(token_pieces(docs, tokenizer, rule, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan_sequences(counts, rule.capacity))
    placed, names = numbered(pieces, F.col("doc_id"), F.col("piece"), column="number", by="length"), [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = places.of(length, number - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return placed.select(*pieces.columns, "number").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that have their ids: a sequence's ids as little-endian unsigned 32-bit integers, at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
