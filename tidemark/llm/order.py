"""Training-order materialisation: token ids in fixed-stride shards, shuffled by a keyed permutation.

The ids of every text, each with an end id, are packed into records of a fixed length, partition by
partition; a record's number is its place in that stream. A Feistel network over the least even number
of bits, walked along its cycle while it leaves the range, is a bijection of record numbers to global
slots under a key. Shard k holds the slots from k * shard_records on, in order, so slot s starts at byte
(s mod shard_records) * stride of shard s // shard_records: a reader goes on at any slot, and reads
sequentially from there.

Shards are written by Spark's text writer, which commits whole files only; its one-byte line separator behind each
record is part of the stride.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.blocks import mix

_U = np.uint64


@dataclass(frozen=True)
class OrderRule:
    """Ids are `id_bytes` wide, and so are `end` and `pad`, which no text's ids hold. The defaults are byte ids: no UTF-8 text holds the bytes 254 (padding)
    and 255 (end). Token ids of four bytes, as `encode_pieces` gives them, take for example the last two values of their range (`TOKEN_IDS`)."""

    record_ids: int = 2_048
    shard_records: int = 16_384
    key: int = 0x5EED
    rounds: int = 6
    id_bytes: int = 1
    end: bytes = b"\xff"
    pad: bytes = b"\xfe"

    @property
    def record_bytes(self) -> int:
        return self.record_ids * self.id_bytes

    @property
    def stride(self) -> int:
        return self.record_bytes + 1


TOKEN_IDS = OrderRule(record_ids=512, id_bytes=4, end=b"\xff\xff\xff\xff", pad=b"\xfe\xff\xff\xff")


class Permutation:
    """Bijection of range(n) under a key."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = _U((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + mix(np.array([key % (1 << 64)], np.uint64)))

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while (out := x >= _U(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right + key) & self.mask)
        return (left << _U(self.half)) | right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (mix(left + key) & self.mask), left
        return (left << _U(self.half)) | right

    def slot(self, number) -> np.ndarray:
        return self._walk(number, self._forward)

    def number(self, slot) -> np.ndarray:
        return self._walk(slot, self._backward)


def _payload(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("payload"))


def _plan(docs: DataFrame, column: str, rule: OrderRule) -> tuple[dict[int, tuple[int, int, int]], int]:
    """{partition: (first record, bytes, sum of checksums)} and the number of all records; a row for each partition comes to the driver."""
    sizes = _payload(docs, column).select(F.spark_partition_id().alias("p"), (F.octet_length("payload") + len(rule.end)).cast("long").alias("n"), F.crc32("payload").alias("c"))
    at, out = 0, {}
    for row in sizes.groupBy("p").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).orderBy("p").collect():
        out[row["p"]] = (at, row["n"], row["c"])
        at += -(-row["n"] // rule.record_bytes)
    return out, at


def packed_records(docs: DataFrame, rule: OrderRule = OrderRule(), column: str = "text") -> tuple[DataFrame, int]:
    """(slot, shard, record, n_ids, doc_ids) of every record, and their number.

    `column` is text (its UTF-8 bytes are the ids) or binary ids of `id_bytes` each. `doc_ids` lists the documents with ids in
    the record. Null and empty texts give their end id alone; repeated rows and rows without an id are packed like others.
    Partitions must hold the same rows whenever they are computed, as those of a table scan or a checkpoint
    do; a partition whose texts have changed fails instead of being written wrongly. `doc_ids` has the type of doc_id.
    """
    starts, total = _plan(docs, column, rule)
    order, width = Permutation(total, rule.key, rule.rounds), rule.record_bytes
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        pid = TaskContext.get().partitionId()
        first, expected, checksum = starts.get(pid, (0, 0, 0))
        held, owners, done, seen, sums = b"", [], 0, 0, 0

        def rows(data: bytes, spans: list[tuple[int, int, object]], count: int):
            slots = order.slot(first + done + np.arange(count))
            ends = np.array([s[1] for s in spans])
            begins = np.array([s[0] for s in spans])
            lo, hi = np.searchsorted(ends, np.arange(count) * width, "right"), np.searchsorted(begins, (np.arange(count) + 1) * width)
            records = [data[k * width : (k + 1) * width] for k in range(count)]
            n = [len(r) // rule.id_bytes for r in records]
            ids = [[s[2] for s in spans[lo[k] : hi[k]]] for k in range(count)]
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array((slots // rule.shard_records).astype(np.int32)), pa.array([r + rule.pad * ((width - len(r)) // len(rule.pad)) for r in records], pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(id_type))],
                names=["slot", "shard", "record", "n_ids", "doc_ids"],
            )

        for batch in batches:
            payload, ids = batch.column("payload"), batch.column("doc_id").to_pylist()
            for lo in range(0, batch.num_rows, 512):
                parts, spans, at = [held], owners, len(held)
                for doc_id, text in zip(ids[lo : lo + 512], payload.slice(lo, 512).to_pylist(), strict=True):
                    spans.append((at, at + len(text) + len(rule.end), doc_id))
                    parts += [text, rule.end]
                    sums += zlib.crc32(text)
                    at = spans[-1][1]
                data = b"".join(parts)
                seen += len(data) - len(held)
                count = len(data) // width
                if count:
                    yield rows(data, spans, count)
                done, used = done + count, count * width
                held, owners = data[used:], [(a - used, b - used, i) for a, b, i in spans if b > used]
        if held:
            yield rows(held, owners, 1)
        if (seen, sums) != (expected, checksum):
            raise RuntimeError(f"partition {pid} has other texts than when it was counted: {seen} bytes of ids and {expected} then")

    return _payload(docs, column).mapInArrow(run, f"slot long, shard int, record binary, n_ids long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>"), total


def write_shards(docs: DataFrame, path: str, rule: OrderRule = OrderRule(), column: str = "text") -> int:
    """Writes all records to `path`, a new folder, and returns their number. One shuffle brings every shard's records together."""
    records, total = packed_records(docs, rule, column)
    shards = max(1, -(-total // rule.shard_records))
    ordered = records.select("slot", "shard", "record").repartitionById(shards, "shard").sortWithinPartitions("slot")
    ordered.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)
    return total


def read_shards(spark: SparkSession, path: str, rule: OrderRule = OrderRule(), from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids) of the records at and after `from_slot`; ids are bytes without padding. Shards before that slot are not read."""

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                count = len(data) // rule.stride
                for lo in range(0, count, 1024):
                    at = range(max(lo, from_slot - shard * rule.shard_records), min(count, lo + 1024))
                    ids = [bytes(data[k * rule.stride : (k + 1) * rule.stride - 1]) for k in at]
                    yield pa.RecordBatch.from_arrays([pa.array([shard * rule.shard_records + k for k in at], pa.int64()), pa.array([shard] * len(at), pa.int32()), pa.array([k * rule.stride for k in at], pa.int64()), pa.array([_unpadded(r, rule) for r in ids], pa.binary())], names=["slot", "shard", "byte_offset", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int")
    return files.select(shard.alias("shard"), "content").filter(F.col("shard") >= from_slot // rule.shard_records).mapInArrow(run, "slot long, shard int, byte_offset long, ids binary")


def _unpadded(record: bytes, rule: OrderRule) -> bytes:
    end = len(record)
    while record.endswith(rule.pad, 0, end):
        end -= len(rule.pad)
    return record[:end]


def record_digests(records: DataFrame) -> DataFrame:
    """`records` with the SHA-256 and the number of bytes of `ids` in its place."""
    return records.withColumns({"n_bytes": F.octet_length("ids").cast("long"), "ids_sha256": F.sha2("ids", 256)}).drop("ids")
