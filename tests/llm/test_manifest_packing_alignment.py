"""Merkle manifest, packing and alignment against plain code, the libraries and SQL, on odd rows too."""

import glob
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import align, manifest, packing, queries
from tidemark.llm.bytelevel import byte_level
from tidemark.llm.shared import fresh_folder

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns have the names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, length long, links string, number long"
TEXTS = [None, "", " ", "one", "one", "  two  spaces ", "naïve café — “quoted” 日本語 🙂🧿 ᚠ x", "a\tb\r\n\n\nc\x00d\x1fe", "it's <|endoftext|> and </s> <s> <0x41> [INST]", "marks ▁ and ▁▁x", "ﬁ ① ﷺ é ﻿", "1234567 3.14 x=1;y==2", "long " * 3_000 + "word", "x" * 5_000, "    a", "'s 't're I'll'd"]


def odd(spark):
    rows = [(i, t, ("en", None, "", "de")[i % 4], None if i % 5 == 0 else f"s{i % 2}", None if i % 3 == 0 else i) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (7, "again", None, None, None), (3, "one", "de", "s1", None)]
    return spark.createDataFrame([(*r, "x", 1, "x", 1, "x", 1) for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels, i):
    return [nodes[i >> h ^ 1] if i >> h ^ 1 < len(nodes) else None for h, nodes in enumerate(levels[:-1])], [bool(i >> h & 1) for h in range(len(levels) - 1)]


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    trees = {lang: sorted(leaves, key=lambda x: x[:3]) for lang, leaves in by.items()}
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    levels = {lang: plain_levels([leaf for _, _, leaf, _ in trees[lang]]) for lang in order}
    top = plain_levels([levels[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(trees[lang]):
            (a, left_a), (b, left_b) = plain_siblings(levels[lang], i), plain_siblings(top, t)
            out.append((r["doc_id"], lang, i, leaf, levels[lang][-1][0], top[-1][0], a + b, left_a + left_b))
    return out


@pytest.mark.parametrize("every", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, every):
    docs, folder = odd(spark), fresh_folder(spark, "manifest")
    manifest.write_manifest(docs, folder, every=every)
    found = manifest.proofs(spark, folder, every)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_manifest(docs.collect())))
    folded = found.select(manifest.fold(F.col("leaf"), F.col("siblings"), F.col("left")).alias("f"), "root")
    assert all(r["f"] == r["root"] for r in folded.collect())


def test_manifest_of_many_rows_of_one_language_shuffled(spark):
    """Three stored levels; the same root however rows come, another one if any value differs."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    roots = []
    for version in (docs, docs.orderBy(F.xxhash64("doc_id")), docs.withColumn("n_chars", F.when(F.col("doc_id") == 299, -1).otherwise(F.col("n_chars")))):
        folder = fresh_folder(spark, "manifest")
        manifest.write_manifest(version, folder, every=3)
        found = manifest.proofs(spark, folder, every=3)
        roots.append({r["root"] for r in found.select("root").collect()})
        if version is docs:
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_manifest(docs.collect())))
    assert roots[0] == roots[1] != roots[2] and len(roots[2]) == 1


def test_manifest_without_rows(spark):
    folder = fresh_folder(spark, "manifest")
    manifest.write_manifest(nothing(spark), folder)
    assert manifest.proofs(spark, folder).collect() == []


def test_manifest_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.op11_merkle_manifest(spark, sf_dir)
    want = con.sql(queries.oracle_sql()["op11_merkle_manifest"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.select(*sorted(want.columns)).fetchall()))
    tampered = {r["doc_id"] for r in got.filter("not verified").select("doc_id").collect()}
    assert tampered == {r["doc_id"] for r in got.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0} != set()


# Packing


def test_ids_are_the_librarys():
    coder, library = byte_level(BYTES), Tokenizer.from_file(BYTES)
    assert coder.ranks is not None
    r = random.Random(2)
    some = ["".join(r.choice(["a", "B", " ", "  ", "é", "日", "🙂", "7", ".", "\n", "'s", "▁", " ", "́", "ſ", "Ǆ"]) for _ in range(r.randint(1, 60))) for _ in range(2_000)]
    for text in [*TEXTS[1:], *some, " " * 200_000 + "x"]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(docs, packed, rule):
    library, by, places = Tokenizer.from_file(BYTES), defaultdict(list), defaultdict(list)
    for r in packed:
        by[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        ends = list(accumulate(n for _, n in sorted(spans)))
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= rule.capacity
    want = Counter()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [rule.end]
        first = len(ids) % rule.capacity or rule.capacity
        for piece, (lo, hi) in enumerate(zip([0, *range(first, len(ids), rule.capacity)], range(first, len(ids) + 1, rule.capacity), strict=True)):
            want[(r["doc_id"], piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    return len(places)


@pytest.mark.parametrize("capacity", [7, 64, 1_024])
def test_packing_of_odd_rows(spark, capacity):
    rule = packing.PackRule(capacity)
    docs = odd(spark)
    packed = packing.pack(docs, BYTES, rule).persist()
    check_packing(docs.collect(), packed.collect(), rule)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert sum(r["length"] for r in whole.values()) == sum(len(r["ids"]) // 4 for r in whole.values()) == sum(r["length"] for r in packed.collect())
    assert packing.pack(nothing(spark), BYTES, rule).collect() == []


def test_packing_of_the_given_documents(spark, sf_dir):
    packed = queries.op12_best_fit_packing(spark, sf_dir).collect()
    n = check_packing(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), packed, packing.PackRule())
    assert n <= 1.02 * -(-sum(r["length"] for r in packed) // 1_024) + 1


def fewest(lengths, capacity):
    """Least number of sequences by trying all ways."""
    best = [len(lengths)]

    def go(left, rooms):
        if len(rooms) >= best[0] and left:
            return
        if not left:
            best[0] = min(best[0], len(rooms))
            return
        n, rest = left[0], left[1:]
        for room in {*rooms}:
            if room >= n:
                more = [*rooms]
                more[more.index(room)] -= n
                go(rest, more)
        go(rest, [*rooms, capacity - n])

    go(sorted(lengths, reverse=True), [])
    return best[0]


def test_plans_use_every_piece_once_and_few_sequences():
    r = random.Random(4)
    worse = 0
    for _ in range(120):
        lengths = [r.randint(1, 24) for _ in range(r.randint(1, 9))]
        plan = packing.plan_sequences(Counter(lengths), 24)
        assert Counter(n for parts, times in plan for n in parts for _ in range(times)) == Counter(lengths) and all(sum(parts) <= 24 for parts, _ in plan)
        worse += sum(times for _, times in plan) - fewest(lengths, 24)
    assert worse <= 2


def test_exact_complements_of_one_to_three():
    for lengths in ((10,), (7, 3), (6, 3, 1), (4, 3, 2, 1), (5, 5), (4, 2, 2, 2)):
        left = [0] * 11
        for n in lengths:
            left[n] += 1
        (parts, times), *more = packing.exact_sequences(left)
        assert (tuple(sorted(parts, reverse=True)), times, more) == (lengths, 1, []) and not any(left)


# Alignment


def plain_alignment(texts):
    a_side, b_side, coder = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES), align.aligner(BYTES, PIECES)
    a_side.encode_special_tokens = True
    rows = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if not text or b"".join(coder.a_raw[i] for i in a) != whole or b"".join(coder.b_raw[i] for i in b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = ({e: k + 1 for k, e in enumerate(accumulate(len(raw[i]) for i in ids))} for ids, raw in ((a, coder.a_raw), (b, coder.b_raw)))
        at_a, at_b, groups, links = 0, 0, [], []
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append((a[at_a : ends_a[e]], b[at_b : ends_b[e]]))
            at_a, at_b = ends_a[e], ends_b[e]
            links.append((a[at_a - 1], b[at_b - 1]))
        rows.append((len(a), len(b), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), links))
    counts = Counter(pair for r in rows if r for pair in r[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(r[0], r[1], len(r[3]), len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(r[2].encode()).hexdigest(), r[2]) if r else (0, 0, 0, 0, 0, 0, "", "") for r in rows]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def test_alignment_of_odd_and_random_texts(spark):
    r = random.Random(6)
    some = ["".join(r.choice(["the", "Qx", " ", " ", "  ", "é", "日本", "🧿", "ᚠ", "7", ".", "\n", "'s", "▁", " ", "é", "\x1f", "​"]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + k, t, "en", "s", 1, "x", 1, "x", 1, "x", 1) for k, t in enumerate(some)], SCHEMA))
    rows = docs.collect()
    got = align.align_documents(docs, BYTES, PIECES).collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True)]
    assert sorted((repr((g["doc_id"], *(g[c] for c in ALIGNED))) for g in got)) == sorted(map(repr, want))
    assert sum(w[1] == 0 for w in want) > 10 and sum("," in w[-1] for w in want) > 100


def test_alignment_of_the_given_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED[:-1]) for r in queries.op13_cross_tokenizer_alignment(spark, sf_dir).collect()}
    assert got == {i: w[:-1] for i, w in zip(docs, plain_alignment(docs.values()), strict=True)}
    assert align.align_documents(nothing(spark), BYTES, PIECES).collect() == []


def test_spans_are_refined_by_bytes_between_coarse_cuts():
    ends, coarse, sizes = np.array([2, 5, 5, 5, 9]), np.array([True, False, False, True, True]), np.array([2, 1, 1, 1, 4])
    assert align.refined(ends, coarse, sizes).tolist() == [2, 3, 4, 5, 9]
    assert align.refined(np.array([3, 3, 3]), np.array([False, False, True]), np.array([1, 1, 1])).tolist() == [1, 2, 3]


def test_forgetting_parts_changes_nothing(monkeypatch):
    coder = align.Aligner(BYTES, PIECES)
    texts = ["the cat sat", "the dog 日 sat", "▁", "", "the cat 🧿"] * 3
    want = list(coder.aligned(texts))
    monkeypatch.setattr(align, "PARTS", 2)
    small = align.Aligner(BYTES, PIECES)
    assert [x for t in texts for x in small.aligned([t])] == want
