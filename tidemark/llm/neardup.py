"""Near-duplicate classes: BagMinHash signatures, banding, exact multiset overlap.

A text is the multiset of its five-word shingles; two texts are linked when their weighted Jaccard
similarity (sum of the lesser counts over sum of the greater counts) is at least 0.8, and a class is a
connected set of texts. Texts that are the same byte for byte are one node from the start.

Signatures. Every shingle owns one Poisson process over (time, slot, level) for each dyadic block of
levels, (0, 1], (1, 2], (2, 4], ... of rate 1, 1, 2, ...; a point counts for a text if its level is within the shingle's
count there. These blocks are the hierarchy: the levels of a count are covered by the blocks up to it, and only its last
block is thinned, instead of splitting every process from one root. The least time in each slot is one component, and two
texts agree in a slot with the probability of their weighted Jaccard similarity, exactly, as counts are whole numbers.
Processes are read in order of time and left as soon as they pass the text's largest component, so a text costs about
m ln m + (number of shingles) points and not their product.

Candidates. Texts that agree in a whole band share a bucket; of buckets with the same texts one is kept. A bucket is sliced, every slice names a leader, its texts are
compared with that leader which they meet in most buckets, and leaders with the bucket's first one. From then on only texts of different classes are compared: in
buckets that hold more than one class so far, the texts outside the largest class meet a few texts of that class, and those
that are still outside after that are held, in blocks, against the bucket's texts of about their size as these stream by;
only pairs that link classes come out of that and are verified. So no bucket emits all its pairs, and no link between
classes is passed over. The last step costs the product of the outsiders and the texts of about their size in a bucket, divided
over as many groups as there are blocks and slices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import TextBlock, map_texts, mix
from tidemark.llm.components import ROWS, components
from tidemark.llm.shared import cut, unused

_U = np.uint64


@dataclass(frozen=True)
class NearRule:
    """A pair at the threshold shares none of 32 bands of 5 slots with a probability of 3e-6."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    seed: int = 1
    #: Texts of a bucket that share a leader; rounds in which outsiders meet a text of a bucket's largest class; texts that a task holds at once in the last round, and that pass by these.
    share: int = 256
    turns: int = 1
    block: int = 256
    slice: int = 2_048


def bag(block: TextBlock, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count), sorted."""
    doc, h = block.shingles(words)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, slots: int, seed: int) -> np.ndarray:
    """(n, slots) least times; infinite where a text has no items."""
    best = np.full((n, slots), np.inf)
    flat = best.reshape(-1)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(item)), levels)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    span = np.where(block > 0, 2.0 ** np.maximum(block - 1, 0), 1.0)
    key = mix(item[owner] + mix(block.astype(np.uint64) + _U(seed) * _U(1 << 32)))
    low, top, text, time = np.where(block > 0, span, 0.0), weight[owner].astype(np.float64), doc[owner], np.zeros(len(owner))
    turn, limit = 0, np.full(n, np.inf)
    while len(key):
        turn += 1
        u = mix(key + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((u >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / span
        v = mix(u ^ _U(0xA0761D6478BD642F))
        slot = text * slots + (((v >> _U(32)) * _U(slots)) >> _U(32)).astype(np.int64)
        level = low + (v & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * span
        counts = (level < top) & (time < flat[slot])
        np.minimum.at(flat, slot[counts], time[counts])
        if turn <= 4 or turn % 8 == 0:
            open_texts = np.unique(text) if turn > 8 else np.arange(n)
            limit[open_texts] = best[open_texts].max(axis=1)
        on = time < limit[text]
        if not on.all():
            key, span, low, top, text, time = (x[on] for x in (key, span, low, top, text, time))
    return best


def band_keys(best: np.ndarray, rule: NearRule) -> np.ndarray:
    """(n, bands) bucket keys as signed 64-bit integers."""
    bits = np.ascontiguousarray(best).view(np.uint64).reshape(len(best), rule.bands, rule.rows)
    key = mix(np.arange(rule.bands, dtype=np.uint64) + _U(rule.seed))[None, :] + np.zeros((len(best), 1), np.uint64)
    for r in range(rule.rows):
        key = mix(key * _U(31) + bits[:, :, r])
    return key.view(np.int64)


def _with_node(docs: DataFrame, text: str, name: str = "__node") -> DataFrame:
    return docs.withColumn(name, F.unhex(F.md5(F.col(text).cast("binary"))))


def _signed(docs: DataFrame, rule: NearRule, id_: str, text: str) -> DataFrame:
    """One row per distinct text with a word: node, first_id, copies, bands."""

    def sign(block: TextBlock) -> dict:
        best = signatures(*bag(block, rule.words), block.n, rule.bands * rule.rows, rule.seed)
        flat = pa.array(band_keys(best, rule).reshape(-1), pa.int64())
        return {"bands": pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * rule.bands, pa.int32()), flat)}

    texts = _with_node(docs.select(id_, text), text).filter(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    signed = map_texts(texts, sign, "bands array<long>", keep=(id_, "__node"), text=text)
    return signed.groupBy(F.col("__node").alias("node")).agg(F.min(id_).alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))


def _item_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, items): sorted 64-bit hashes of (shingle, how often it has come so far). Their set overlap is the overlap of the multisets."""

    def collect(block: TextBlock) -> dict:
        doc, h, count = bag(block, words)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc, item = np.repeat(doc, count), mix(np.repeat(h, count) + mix(nth.astype(np.uint64)))
        item = item[np.lexsort((item, doc))].view(np.int64)
        ends = np.append(0, np.cumsum(block.sums(doc))).astype(np.int32)
        return {"items": pa.ListArray.from_arrays(pa.array(ends), pa.array(item))}

    return map_texts(texts, collect, "items array<long>", keep=("node",), text="body")


def _few(rows: DataFrame) -> DataFrame:
    """`rows`, written once and read in no more partitions than their number asks for: every exchange behind leaves a file for each of these, however few rows they have."""
    stored = cut(rows)
    return stored.coalesce(max(1, -(-stored.count() // ROWS)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, leader, similarity) of the pairs (node, leader): their weighted Jaccard similarity."""
    named = pairs.join(sets.select("node", F.col("items").alias("a")), "node").join(sets.select(F.col("node").alias("leader"), F.col("items").alias("b")), "leader")
    both = F.size(F.array_intersect("a", "b"))
    return named.select("node", "leader", (both / (F.size("a") + F.size("b") - both)).alias("similarity"))


def _merged(roots: DataFrame | None, seen: DataFrame, rule: NearRule) -> DataFrame:
    """(node, root) of the classes `roots` after the links among `seen`."""
    links = seen.filter(F.col("similarity") >= rule.similarity).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _mixed(waiting: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, node, weight, root, most) of buckets that hold more than one class; most is a bucket's largest class."""
    rooted = waiting.select("key", "node", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("most")).filter("roots > 1").select("key", "most")
    mixed = _few(mixed)
    return _few(rooted.join(mixed, "key"))


def _most_shared(met: DataFrame, n: int) -> DataFrame:
    """Of the texts that each text meets in buckets, rows (node, leader, weight), the n that it meets in most, as pairs with the greater node first."""
    counts = met.filter("leader <> node").groupBy("node", "leader").agg(F.sum("weight").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "leader"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()


def _slot(column: str, rows: Column, most: int, seed: int) -> Column:
    """A number below ceil(rows / most) from a hash of the column: about `most` rows share one."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.ceil(rows / most)).cast("int")


def _outsiders(mixed: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs (node, leader) of texts of different classes in one bucket that are about similar enough.

    Sizes of linked texts differ by a factor of 1 / similarity at most, so texts meet only those of their own class of size, which spans four such factors,
    and of the next one if their size is within a factor of it. In each class of size, the texts outside the bucket's largest class of links are
    held in blocks, and the bucket's texts pass by in slices as sorted streams; blocks and slices have about a fixed number of texts,
    so a large bucket is many small groups.
    """
    at = F.log(F.size("items").cast("double")) / (4 * math.log(1 / rule.similarity))
    whole = lambda shift: F.floor(at + shift).cast("int")
    sized = sets.select("node", whole(0).alias("class"), F.array_distinct(F.array(whole(-0.2501), whole(0.2501))).alias("meets"))
    rows = _few(mixed.join(sized, "node"))
    odd, met = rows.filter("root <> most"), rows.withColumn("class", F.explode("meets"))
    held, passing = odd.groupBy("key", "class").agg(F.count("*").alias("held")), met.groupBy("key", "class").agg(F.count("*").alias("passing"))
    groups = _few(held.join(passing, ["key", "class"]))
    several = lambda n, most: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / most) - 1).cast("int")))
    deal = odd.join(groups, ["key", "class"]).withColumn("block", _slot("node", F.col("held"), rule.block, 1)).withColumn("slice", several("passing", rule.slice))
    probes = met.join(groups, ["key", "class"]).withColumn("slice", _slot("node", F.col("passing"), rule.slice, 2)).withColumn("block", several("held", rule.block))
    place = ["key", "class", "block", "slice"]
    both = deal.select(*place, F.lit(0).alias("role"), "node", "root").unionByName(probes.select(*place, F.lit(1).alias("role"), "node", "root"))
    short = sets.select("node", F.transform("items", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")).alias("items"))
    dealt = both.join(short, "node").repartition(*place).sortWithinPartitions(*place, "role")

    def run(batches):
        group, held, table, local = None, [], None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                where = np.column_stack([part.column(c).to_numpy().astype(np.int64) for c in (*place, "role")])
                lists = part.column("items")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                rows = list(zip(part.column("node").to_pylist(), part.column("root").to_pylist(), (flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), strict=True))
                edges = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1)))
                out: list[tuple[bytes, bytes]] = []
                for i, j in zip(edges, [*edges[1:], len(rows)], strict=True):
                    if tuple(where[i, :4]) != group:
                        group, held, table, local = tuple(where[i, :4]), [], None, {}
                    if where[i, 4] == 0:
                        held += rows[i:j]
                    if where[i, 4] == 0 or not held:
                        continue
                    table = _table(held) if table is None else table
                    out += _similar_pairs(rows[i:j], held, table, rule.similarity, local)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["node", "leader"])

    return dealt.select(*place, "role", "node", "root", "items").mapInArrow(run, "node binary, leader binary").distinct()


def _table(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items sorted, their owners, number of items of each owner) of the held texts."""
    items, sizes = np.concatenate([r[2] for r in held]), np.array([len(r[2]) for r in held])
    order = np.argsort(items, kind="stable")
    return items[order], np.repeat(np.arange(len(held)), sizes)[order], sizes


def _similar_pairs(rows: list, held: list, table: tuple, similarity: float, local: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
    """Pairs of different roots whose overlap reaches the similarity, or misses it by one item at the most, as short hashes may tell.

    `local` joins the roots that a group has linked beyond doubt, so a group gives a pair for each link between its classes and not for
    all texts of them. One text at a time meets the held ones, so that memory follows its items times the held texts.
    """
    items, owners, sizes = table
    out = []

    def root(x: bytes) -> bytes:
        while x in local:
            x = local[x]
        return x

    for node, own, asked in rows:
        first = np.searchsorted(items, asked, "left")
        hits = np.searchsorted(items, asked, "right") - first
        owner = owners[np.arange(hits.sum()) + np.repeat(first - np.cumsum(hits) + hits, hits)]
        both = np.bincount(owner, minlength=len(held))
        need = np.ceil(similarity / (1 + similarity) * (len(asked) + sizes) - 1e-9)
        at = np.flatnonzero(both >= need - 1)
        for b in at[np.argsort(-both[at], kind="stable")]:
            mine, other = root(own), root(held[b][1])
            if mine != other:
                out.append((max(node, held[b][0]), min(node, held[b][0])))
                if both[b] > need[b]:
                    local[max(mine, other)] = min(mine, other)
    return out


def _roots(signed: DataFrame, docs: DataFrame, rule: NearRule, id_: str, text: str) -> DataFrame:
    """(node, root) of the texts that are linked to another text."""
    keyed = signed.select("node", F.explode("bands").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), *members).filter("n > 1")
    shared = _few(shared.groupBy("n", "members1", "members2").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "n", "weight"))
    waiting = _few(keyed.join(shared, "key").select("key", "node", "weight", _slot("node", F.col("n"), rule.share, 0).alias("slice")))
    wanted = waiting.select("node").distinct().join(signed.select("node", "first_id"), "node")
    own = _with_node(docs.select(F.col(id_).alias("first_id"), F.col(text).alias("body")), "body").withColumnRenamed("__node", "node")
    texts = own.join(wanted.withColumnRenamed("first_id", "f"), "node").filter(F.col("first_id").eqNullSafe(F.col("f"))).select("node", "body").dropDuplicates(["node"])
    sets = cut(_item_sets(texts, rule.words))
    heads = waiting.groupBy("key", "slice").agg(F.min("node").alias("leader"))
    chiefs = heads.groupBy("key").agg(F.min("leader").alias("chief"))
    met = waiting.join(heads, ["key", "slice"]).select("node", "leader", "weight").unionByName(heads.join(chiefs, "key").select(F.col("leader").alias("node"), F.col("chief").alias("leader"), F.lit(1).alias("weight")))
    seen = _few(_verified(_most_shared(met, 1), sets))
    roots = _merged(None, seen, rule)
    mixed = _mixed(waiting, roots)
    for turn in range(rule.turns):
        if mixed.isEmpty():
            return roots
        heads = _few(mixed.filter("root = most").groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("leader")))
        met = mixed.filter("root <> most").join(heads, "key").select("node", "leader", "weight")
        more = _few(_verified(_most_shared(met, 2).join(seen, ["node", "leader"], "left_anti"), sets))
        roots, seen = _merged(roots, more, rule), seen.unionByName(more)
        mixed = _mixed(mixed, roots)
    last = _few(_verified(_outsiders(mixed, sets, rule).join(seen, ["node", "leader"], "left_anti"), sets))
    return roots if last.isEmpty() else _merged(roots, last, rule)


def _classes(docs: DataFrame, rule: NearRule, id_: str, text: str) -> DataFrame:
    """(node, first_id, copies, class_id, class_node, class_size) of every distinct text in a class of two rows or more."""
    signed = cut(_signed(docs, rule, id_, text))
    roots = _roots(signed, docs, rule, id_, text)
    nodes = signed.select("node", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("node").alias("node"))).alias("first")
    whole = nodes.groupBy("root").agg(first, F.sum("copies").alias("class_size")).filter("class_size > 1")
    return cut(nodes.join(whole, "root").select("node", "first_id", "copies", F.col("first.id").alias("class_id"), F.col("first.node").alias("class_node"), "class_size"))


def near_duplicates(docs: DataFrame, rule: NearRule = NearRule(), id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, class_id and class_size (rows in the class).

    class_id is the least id in the class. Texts of fewer than five words are one shingle of all their
    words. A null text, or one without a word, is in a class of its own. Rows without an id take part; a class has a
    null class_id only if none of its rows has an id. Repeated rows count as copies. Columns other than
    id and text are not read.
    """
    classes = _classes(docs, rule, id_, text).select(F.col("node").alias("__node"), "class_id", "class_size")
    rows = _with_node(docs.select(id_, text), text).select(id_, "__node").join(classes, "__node", "left")
    alone = F.col("class_size").isNull()
    return rows.select(id_, F.when(alone, F.col(id_)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_first(docs: DataFrame, rule: NearRule = NearRule(), id_: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each class: the row of the least id (rows without an id last); of rows with equal id and text any one. Other rows and all columns stay as they are."""
    node, first, lead = unused(docs, "node", "first", "lead")
    classes = _classes(docs, rule, id_, text).select(F.col("node").alias(node), F.col("first_id").alias(first), (F.col("node") == F.col("class_node")).alias(lead))
    tied = _with_node(docs, text, node).join(classes, node, "left")
    alone = tied.filter(F.col(lead).isNull())
    firsts = tied.filter(F.col(lead) & F.col(id_).eqNullSafe(F.col(first))).dropDuplicates([node])
    return alone.unionByName(firsts).select(*docs.columns)
