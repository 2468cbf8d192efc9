"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language, lm, neardup, order, quality, secrets, sentencepieces, toxicity
from tidemark.llm.blocks import TextBlock
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __node string, __best string, __clean string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "n", "k", "b") for i, t in rows], SCHEMA)


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "an", "er", "ou", "st", "é", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "  \n\t"), (None, "no id here"), (4, "one"), (4, "one"), (5, prose(1)), (6, prose(1)), (7, "long " * 30_000), (8, "日本語🙂 \x00 é▁")]


def everything(spark):
    return frame(spark, ODD)


def nothing(spark):
    return frame(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# near duplicates


def similarity(a, b, k=5):
    def bag(t):
        w = WORD.findall(t or "")
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 0.0


def brute_classes(docs):
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(docs, 2):
        if similarity(a, b) >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_neardup_equals_brute_force(spark):
    base, repeats = prose(3, 150), "a b c d e f g " * 30
    docs = [(i, edited(base, i % 9, i)) for i in range(60)] + [(100 + i, prose(100 + i)) for i in range(10)] + [(200, base), (201, base), (202, repeats), (203, repeats + "h i"), (204, "a b c d e f g")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_classes(docs)


def test_neardup_in_small_slices_and_blocks(spark):
    """Chains of copies, each near its neighbours only, in classes that share buckets, with slices and blocks of a few texts."""
    docs, rule = [], neardup.NearRule(share=3, block=3, slice=4)
    for chain in range(3):
        words = prose(900, 120).split()
        r = random.Random(chain)
        for k in range(25):
            docs.append((chain * 100 + k, " ".join(words)))
            for at in range(k * 4, k * 4 + 4):
                words[at % 120] = f"c{r.randrange(10**6)}"
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, docs), rule).collect()}
    want = brute_classes(docs)
    assert got == want and len(set(want.values())) < len(docs)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    item = np.array([1, 2, 3, 1, 2, 4], np.uint64) * np.uint64(7919)
    doc, weight = np.array([0, 0, 0, 1, 1, 1]), np.array([3, 1, 2, 1, 5, 2])
    agree = []
    for seed in rng.integers(1, 10**6, 60):
        best = neardup.signatures(doc, item, weight, 2, 128, int(seed))
        agree.append((best[0] == best[1]).mean())
    assert abs(np.mean(agree) - (1 + 1) / (3 + 5 + 2 + 2)) < 0.015


def test_neardup_odd_rows(spark):
    got = neardup.near_duplicates(everything(spark))
    found = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got.collect())
    assert found[(4, 4, 2)] == 2 and found[(5, 5, 2)] == found[(6, 5, 2)] == 1 and found[(1, 1, 1)] == found[(2, 2, 1)] == found[(3, 3, 1)] == 1 and found[(None, None, 1)] == 1
    kept = neardup.keep_first(everything(spark))
    assert kept.columns == everything(spark).columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 5, 7, 8])
    assert neardup.near_duplicates(nothing(spark)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(55, 50), (50, 55), (60, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(41) if i % 10} | {55: 50}


# training order


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = order.Permutation(n, 5)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    assert (order.Permutation(1000, 5).slot(np.arange(1000)) != order.Permutation(1000, 6).slot(np.arange(1000))).any()


def test_shards_round_trip_and_resume(spark, tmp_path):
    rule = order.OrderRule(record_ids=64, shard_records=50)
    docs, path = everything(spark), str(tmp_path / "shards")
    n = order.write_shards(docs, path, rule)
    found = order.read_shards(spark, path, rule).orderBy("slot").collect()
    assert [r["slot"] for r in found] == list(range(n)) and all(r["byte_offset"] == r["slot"] % 50 * 65 for r in found)
    numbers = order.Permutation(n, rule.key, rule.rounds).number(np.arange(n))
    stream = b"".join(ids for _, ids in sorted(zip(numbers.tolist(), (r["ids"] for r in found), strict=True)))
    assert sorted(stream.split(b"\xff")[:-1]) == sorted((t or "").encode() for _, t in ODD)
    assert order.read_shards(spark, path, rule, from_slot=75).count() == n - 75
    assert order.packed_records(nothing(spark), rule)[1] == 0


def test_token_ids_round_trip(spark, tmp_path):
    """Ids of four bytes from the tokenizer, ids of documents that are strings, and a reader that goes on in the middle."""
    data = [(f"d{i}", prose(i, 30 + i)) for i in range(40)] + [(None, None), ("d1", "")]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    coded, path = sentencepieces.encode_pieces(docs, MODEL).select("doc_id", "ids"), str(tmp_path / "ids")
    rule = order.OrderRule(record_ids=16, shard_records=20, id_bytes=4, end=order.TOKEN_IDS.end, pad=order.TOKEN_IDS.pad)
    n = order.write_shards(coded, path, rule, "ids")
    found = {r["slot"]: bytes(r["ids"]) for r in order.read_shards(spark, path, rule).collect()}
    stream = b"".join(found[int(s)] for s in order.Permutation(n, rule.key, rule.rounds).slot(np.arange(n)))
    texts, at = [], np.frombuffer(stream, "<u4")
    for end in np.flatnonzero(at == 0xFFFFFFFF):
        texts.append(at[sum(len(t) + 1 for t in texts) : end])
    assert sorted(t.tobytes() for t in texts) == sorted(bytes(r["ids"]) for r in coded.collect())
    assert {r["slot"] for r in order.read_shards(spark, path, rule, from_slot=n // 2).collect()} == set(range(n // 2, n))
    owners = {i for r in order.packed_records(coded, rule, "ids")[0].collect() for i in r["doc_ids"]}
    assert owners == {i for i, _ in data}


def test_changed_partitions_are_not_written(spark, tmp_path):
    """Texts of the same length that change between the count and the write, and rows that come or go, fail the write."""
    source = tmp_path / "source"
    path, rule = str(source), order.OrderRule(record_ids=8)
    current = F.udf(lambda _: open(path).read(), "string").asNondeterministic()
    docs = spark.range(3, numPartitions=1).select(F.col("id").alias("doc_id"), current("id").alias("text"))
    source.write_text("abcd")
    records, total = order.packed_records(docs, rule)
    assert records.count() == total == 2
    for changed in ("abce", "abcde", "abc", ""):
        source.write_text(changed)
        with pytest.raises(Exception, match="has other texts than when it was counted"):
            records.collect()


def test_records_name_their_ids_and_documents(spark):
    """`n_ids`, `doc_ids`, the bytes and the slot of every record against plain code over one stream of texts."""
    r, rule = random.Random(8), order.OrderRule(record_ids=16, shard_records=3)
    texts = ["x" * r.choice([0, 1, 14, 15, 16, 17, 50, 200]) + r.choice(["", "é"]) for _ in range(700)]
    records, total = order.packed_records(frame(spark, enumerate(texts)).coalesce(1), rule)
    stream = [(byte, i) for i, t in enumerate(texts) for byte in t.encode() + rule.end]
    parts = [stream[k : k + 16] for k in range(0, len(stream), 16)]
    slots = order.Permutation(total, rule.key, rule.rounds).slot(np.arange(total)).tolist()
    want = {s: (s // 3, bytes(b for b, _ in part).ljust(16, rule.pad), len(part), sorted({i for _, i in part})) for s, part in zip(slots, parts, strict=True)}
    assert {x["slot"]: (x["shard"], bytes(x["record"]), x["n_ids"], x["doc_ids"]) for x in records.collect()} == want


# chat


def parsed(text, t):
    """(role, text) of the turns of a joined conversation, by its control strings alone."""
    assert text.startswith(t.begin) and text.endswith(t.end)
    rest, turns = text[len(t.begin) : len(text) - len(t.end)], []
    while rest:
        assert rest.startswith(t.role_open)
        role, rest = rest[len(t.role_open) :].split(t.text_open, 1)
        body, rest = rest.split(t.turn_close, 1)
        turns.append((t.unescape(role), t.unescape(body)))
    return turns


def test_joined_conversations_parse(spark):
    t, r = chat.ChatTemplate(), random.Random(5)
    bits = ["\\", ".", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[", "x", "\n", "é"]
    turns = [(c, k, r.choice(["user", "assistant", "[INST]", ""]), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for c in range(30) for k in range(r.randint(1, 5))]
    segments = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for c in range(30):
        own = [x for x in segments if x["conv_id"] == c]
        assert parsed("".join(x["text"] for x in own), t) == [(role, text) for i, _, role, text in turns if i == c]


def test_chat_reads_back(spark):
    both = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "system", None), (1, 1, "user", "a\\b \\. [ROLE]<s>"), (1, 2, "assistant", both), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, None, None, "x"), (-1, 0, "user", both), (-1, 1, "assistant", both)]
    df = spark.createDataFrame([(*t, "extra", True) for t in turns], "conv_id long, turn long, role string, text string, part string, loss boolean")
    segments = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    for conv in (1, 2, None, -1):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        said = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), want)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1]["valid"] and got[-1]["valid"] and not got[2]["valid"]
    assert {r["conv_id"]: r["formatted_chars"] for r in segments.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("formatted_chars")).collect()} == {c: got[c]["formatted_chars"] for c in got}
    assert not [r for r in segments.filter("part = 'text'").collect() if any(c in r["text"] for c in chat.ChatTemplate().controls)]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_machine_has_ends(spark):
    turns = [(1, 0, "system"), (2, 0, "user"), (2, 1, "assistant"), (3, 0, "user"), (3, 1, "assistant"), (3, 2, "user"), (4, 0, "assistant")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in chat.read_back(chat.format_turns(df)).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_escape_is_reversible():
    t, r = chat.ChatTemplate(), random.Random(1)
    for _ in range(2000):
        s = "".join(r.choice(["\\", ".", "<", "s", ">", "</s>", "[INST]", "[", "INST]", "\n", "é"]) for _ in range(r.randint(0, 12)))
        assert t.unescape(t.escape(s)) == s and not any(c in t.escape(s) for c in t.controls)


# language model


def test_lm_base_counts_and_normalisation(spark):
    docs = frame(spark, [*((i, prose(i, 60)) for i in range(40)), *ODD[:6], (99, "Unseen words only")])
    trains = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = [r for r in lm.score_texts(docs, trains, lm.LmRule(classes=20, head=50, rounds=2)).collect()]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts, tokens = Counter(), {}
    for r in docs.collect():
        words = [*WORD.findall(low(r["text"])), None]
        tokens[(r["doc_id"], r["text"])] = words
        if r["doc_id"] is not None and r["doc_id"] % 3:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for r in docs.collect() for i, w in [(r["doc_id"], tokens[(r["doc_id"], r["text"])])])
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(nothing(spark), trains).count() == 0


def test_lm_score_equals_a_plain_sum(spark):
    """Every token by the model's formula: the class in its context, times a rare word's smoothed share of its class."""
    rule = lm.LmRule(classes=15, head=60, rounds=1)
    docs = frame(spark, [*((i, prose(i, 40)) for i in range(30)), (77, "Unseen words, only. é"), (78, None), (79, "")])
    trains = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    counts = lm.word_counts(docs.filter(trains))
    words = lm.vocabulary(counts, rule)
    model = lm.train(lm.trigrams(docs.filter(trains), spark.sparkContext.broadcast(words), words.size), words.log_class(), words.tokens, rule)
    known = {r["word"]: r["n"] for r in counts.collect()}
    head = dict(zip(words.words.tolist(), words.classes.tolist(), strict=True))
    a1, a2, q, b = model.parts
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, trains, rule).collect()}
    for r in docs.collect():
        block = TextBlock(pa.array([r["text"]]), fold=True)
        hashes, rare_shape = block.word_hash.view(np.int64).tolist(), lm.shapes(block).tolist()
        classes = [head.get(h, -1) if head.get(h, -1) >= 0 else words.common + s for h, s in zip(hashes, rare_shape, strict=True)] + [0]
        before, want = [words.size, words.size], 0.0
        for k, c in enumerate(classes):
            s = (a1[before[-1]] + a2[before[-2]]) @ q.T + b + model.log_p
            want += (s[c] - np.log(np.exp(s).sum())) / np.log(10)
            if c >= words.common:
                shape = c - words.common
                want += np.log10((known.get(hashes[k], 0) + 0.5) / (words.rare_tokens[shape] + 0.5 * (words.rare_types[shape] + 1)))
            before.append(c)
        assert abs(got[r["doc_id"]] - want) < 1e-5 * max(1, abs(want))


def test_lm_learns_from_context(spark):
    r = random.Random(8)
    pairs = [("red", "green"), ("one", "two"), ("left", "right"), ("up", "down")]
    docs = frame(spark, [(i, " ".join(w for _ in range(30) for w in r.choice(pairs))) for i in range(150)])
    got = lm.score_texts(docs, F.col("doc_id") % 5 != 1, lm.LmRule(classes=12)).filter("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_log_bilinear_sums_to_one():
    model = lm.LogBilinear.fresh(np.log(np.full(9, 1 / 9)), lm.LmRule())
    p = 10 ** model.log10(np.full(9, 3), np.full(9, 9), np.arange(9))
    assert abs(p.sum() - 1) < 1e-5


def test_lm_pass_takes_every_trigram():
    rule, n = lm.LmRule(), 3_000
    model = lm.LogBilinear.fresh(np.log(np.full(n, 1 / n)), rule)
    before, at = model.parts[0].copy(), np.arange(n)
    counts = np.maximum(1, 1_000_000 // (at + 1))
    lm.contrast(model, at, np.full(n, n), at, counts, np.random.default_rng(0), rule)
    assert (model.parts[0][:n] != before[:n]).any(axis=1).all()


def test_lm_visits_weigh_tokens_alike():
    counts, unit = np.array([1, 2, 70, 10_000, 10_000_000]), 40.0
    at, weight = lm.visits(counts, unit, np.random.default_rng(0))
    assert np.allclose(np.bincount(at, weight) * unit, counts) and weight.max() <= 1 and len(at) <= len(counts) + counts.sum() / unit


# language and toxicity


def test_language(spark):
    words = {"aa": ["alpha", "beta", "gamma"], "bb": ["uno", "dos", "tres"]}
    r = random.Random(2)
    data = [(i, " ".join(r.choice(words[x]) for _ in range(20)), x) for i in range(200) for x in [r.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(docs.drop("lang"), model).collect()}
    assert all(got[i] == x for i, _, x in data)
    odd = rows(language.identify(everything(spark), model).select("doc_id", "lang_pred", "accepted"))
    assert len(odd) == len(ODD) and (1, "und", False) in odd and (2, "und", False) in odd
    assert language.keep_identified(everything(spark), model).columns == everything(spark).columns
    assert {x["lang_pred"] for x in language.identify(everything(spark), language.fit(nothing(spark), F.lit(True))).collect()} == {"und"}
    assert language.identify(nothing(spark), model).count() == 0


def test_language_scores_equal_plain_code(spark):
    r = random.Random(7)
    model = language.train([prose(i, 40) if i % 2 else prose(i, 40).replace("th", "zz") for i in range(60)], ["aa", "bb"] * 30, ["aa", "bb"])
    texts = ["".join(r.choice("abé zþ日\n") for _ in range(r.randint(1, 60))) + "a" for _ in range(40)]
    found = model.probabilities(TextBlock(pa.array(texts), fold=True))
    for text, p in zip(texts, found, strict=True):
        rows = []
        for size in model.rule.sizes:
            for i in range(len(text) - size + 1):
                one = TextBlock(pa.array([text[i : i + size]]), fold=True)
                rows.append(model.rows[int(one.hashes(np.array([0]), np.array([len(one.data)]))[0] & np.uint64(model.rule.buckets - 1))])
        z = ((np.mean(rows, axis=0) if rows else 0) + model.bias) / model.temperature
        assert np.allclose(p, np.exp(z) / np.exp(z).sum())


def test_samples_are_bounded_and_leave_no_label_out(spark):
    """One row many times, a label of long texts only, and more rows than may be drawn."""
    from tidemark.llm.samples import labelled_sample, row_key

    data = [(1, "same", "aa")] * 500 + [(i, f"text {i}", "aa") for i in range(2, 60)] + [(900, "long " * 5_000, "bb"), (901, "longer " * 5_000, "bb")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    rows = labelled_sample(docs.select("lang", row_key().alias("key"), F.octet_length("text").cast("long").alias("n")), docs, "lang", 20, 1_000)
    found = Counter(label for _, label in rows)
    assert found == {"aa": 20, "bb": 1} and len(set(rows)) == 21


def test_one_verdict_on_languages(spark):
    docs = frame(spark, [*ODD, *((200 + i, prose(i, 30)) for i in range(60))])
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "und").otherwise("xx"))
    model = language.fit(labelled, F.lit(True), language.LanguageRule(most_least=0.99))
    accepted = Counter(r["doc_id"] for r in language.identify(docs, model).filter("accepted").collect())
    assert Counter(r["doc_id"] for r in language.keep_identified(docs, model).collect()) == accepted and sum(accepted.values()) > 0


def test_toxicity_scores_equal_plain_code():
    model = toxicity.train([prose(i, 30) + (" idiot moron" if i % 3 == 0 else "") for i in range(90)], [int(i % 3 == 0) for i in range(90)])
    texts = [prose(500 + i, 20) + (" you idiot" if i % 2 else "") for i in range(20)] + ["", "Moron", "日本 idiot"]
    found = model.scores(TextBlock(pa.array(texts), fold=True))
    for text, score in zip(texts, found, strict=True):
        buckets = set()
        for size in model.rule.sizes:
            for i in range(len(text) - size + 1):
                one = TextBlock(pa.array([text[i : i + size]]), fold=True)
                buckets.add(int(one.hashes(np.array([0]), np.array([len(one.data)]))[0] & np.uint64(model.rule.buckets - 1)))
        z = model.bias + sum(model.weights[b] for b in buckets)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity(spark):
    data = [(i, prose(i, 60) + (" idiot moron" if i % 4 == 0 else "")) for i in range(300)]
    docs = frame(spark, data)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i, _ in data] + [(0, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i, _ in data)
    assert toxicity.score_toxicity(everything(spark), model).filter("score between 0 and 1").count() == len(ODD)
    empty = toxicity.fit(nothing(spark), labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(everything(spark), empty).count() == len(ODD)


# tokenizer


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    pieces = ["a", "e", "th", "▁", " ", "  ", "é", "\n", "1", "0", ".", ",", "(", "//", "ing", "\x00", "🙂", "日", "本", "http", "\t", "²", "²."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(500)]
    data = [*enumerate(texts, 100), *ODD]
    got = Counter((x["doc_id"], x["n_tokens"], bytes(x["ids"]), x["decoded"]) for x in sentencepieces.encode_pieces(frame(spark, data), MODEL).collect())
    want = Counter()
    for i, t in data:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids))] += 1
    assert got == want
    assert sentencepieces.encode_pieces(nothing(spark), MODEL).count() == 0


# quality


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark):
    data = [*ODD, (20, "a b c\na b c\n\n x #* |\n x #* |\nz"), (21, "\n\na\n"), (22, prose(9, 300)), (23, "same words here " * 100), (24, "a b c a b c")]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.compression_bands(frame(spark, data)).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in data)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.compression_bands(frame(spark, data)).collect()}
    assert verdict[22] == (False, True) and verdict[23] == (True, False) and verdict[2] == (True, False)
    assert quality.compression_bands(nothing(spark)).count() == 0


def test_quality_judges_every_chunk(spark):
    r = random.Random(6)
    varied = lambda n: prose(r.randrange(10**6), 2_000).encode()[:n].decode(errors="ignore").ljust(n, "x")[:n]
    phrase = (" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(5)) + " ") * 40
    block = phrase[:2_048]
    size = lambda t: len(t.encode())
    texts = [block + " " + varied(1_000), varied(1_000) + " " + block, varied(2_000), varied(4_096), block]
    got = {x["doc_id"]: x for x in quality.compression_bands(frame(spark, enumerate(texts))).collect()}
    assert [got[i]["n_chunks"] for i in range(5)] == [-(-size(t) // 2_048) if size(t) >= 2_048 else 0 for t in texts]
    assert [got[i]["n_bad_chunks"] > 0 for i in range(5)] == [True, True, False, False, True]
    assert not got[0]["kept"] and not got[1]["kept"]


def test_quality_verdict_equals_plain_code(spark):
    import zstandard

    r, bands = random.Random(9), quality.Bands()
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(n))
    texts = [prose(i, r.randint(50, 900)) for i in range(30)] + [" ".join(noise(8) for _ in range(k)) for k in (60, 400, 2_000)] + [(prose(i, 5) + " ") * 60 + prose(i + 1, 400) for i in range(10)] + ["z " * 1_500 + prose(3, 1_600), None, ""]
    got = {x["doc_id"]: x for x in quality.compression_bands(frame(spark, enumerate(texts))).collect()}
    size = lambda b: len(b) / len(zstandard.ZstdCompressor(level=bands.level).compress(b))
    seen = set()
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        ratio, n = (size(raw) if raw else 0.0), bands.chunk_bytes
        chunks = [raw[p : p + n] for p in [*range(0, len(raw) - n, n), len(raw) - n]] if len(raw) >= n else []
        bad = sum(not bands.chunk[0] <= size(c) <= bands.chunk[1] for c in chunks)
        least, most = next((lo, hi) for top, lo, hi in bands.whole if len(raw) <= top)
        words, _, _, _, repeated = brute_quality(text)
        failed = words < 50 or 100 * repeated > 50 * words
        kept = not failed and bool(raw) and least <= ratio <= most and bad <= bands.bad_share * max(1, len(chunks))
        assert (got[i]["base_failed"], got[i]["kept"], got[i]["n_chunks"], got[i]["n_bad_chunks"]) == (failed, kept, len(chunks), bad) and abs(got[i]["ratio"] - ratio) < 1e-12
        seen.add((failed, kept))
    assert seen == {(True, False), (False, True), (False, False)}


# decontamination


def test_leaks(spark):
    items = [(i, prose(1000 + i, 15 + 4 * i)) for i in range(10)]
    docs = [(1000 + i, prose(i, 50) + " " + (re.sub('[a-z]', lambda m: m[0].upper(), t) if i == 3 else t) + " " + prose(50 + i, 40)) for i, t in items]
    docs += [(50, edited(items[9][1], 1, 0)), (51, prose(77, 200)), (52, items[2][1]), *ODD]
    table = spark.createDataFrame([*((i, t, "x") for i, t in items), (90, None, "x"), (91, "", "x"), (0, items[0][1], "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, docs), table).collect()}
    want = set()
    for d, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for i, item in items:
            n = len(item.split())
            if any(similarity(" ".join(w[k : k + n]), item) >= 0.8 for k in range(max(1, len(w) - n + 1))):
                want.add((d, i))
    assert got == want and (1003, 3) in got
    small = decontaminate.LeakRule(windows_at_once=4)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, docs), table, small).collect()} == want
    kept = decontaminate.keep_clean(frame(spark, docs), table)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if d not in {x for x, _ in want})
    assert decontaminate.find_leaks(nothing(spark), table).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs), table.limit(0)).count() == 0


def altered(words, kind, r):
    """`words` after edits that leave a similarity near 0.8; the number of edits follows from `kind`."""
    w, n, fresh = list(words), len(words), lambda k: [f"y{r.randrange(10**9)}" for _ in range(k)]
    room = (n - 4) // 9
    if kind == "last":
        w[-1:] = fresh(1)
    elif kind == "ends":
        w[0:1], w[-1:] = fresh(1), fresh(1)
    elif kind == "stretch":
        k = max(1, room - 4) if n > 16 else 1
        at = r.randrange(n - k + 1)
        w[at : at + k] = fresh(k)
    elif kind == "spread":
        for at in r.sample(range(n), max(1, room // 5)):
            w[at : at + 1] = fresh(1)
    else:
        at = r.randrange(1, n)
        w[at:at] = fresh(max(1, room // 2))
    return w


def test_leaks_at_the_threshold():
    r, rule = random.Random(12), decontaminate.LeakRule()
    lengths = sorted({n for k in range(0, 13) for n in (int(8 * 2 ** (k / 2)), int(8 * 2 ** (k / 2)) + 5)} | {5, 6, 9, 89, 128, 512})
    items, docs, want = [], [], set()
    for n in lengths:
        for kind in ("last", "ends", "stretch", "spread", "insert") * 3:
            words = [f"w{r.randrange(10**9)}" for _ in range(n)]
            before, after = ([f"z{r.randrange(10**9)}" for _ in range(r.choice([0, 7]))] for _ in range(2))
            text = before + altered(words, kind, r) + after
            shingles = [tuple(text[i : i + 5]) for i in range(max(0, len(text) - 4))]
            own, m = {tuple(words[i : i + 5]) for i in range(n - 4)}, n - 4
            best = 0.0
            for at in range(1 - m, len(shingles)):
                run = shingles[max(0, at) : at + m]
                shared = len(own.intersection(run))
                best = max(best, shared / (len(run) + m - shared))
            if best >= rule.similarity:
                want.add((len(items), round(best, 9)))
            items.append(" ".join(words))
            docs.append(" ".join(text))
    index = decontaminate.ItemIndex(list(enumerate(items)), rule)
    found = list(index.hits(TextBlock(pa.array(docs), fold=True)))
    assert all(d == i for d, i, _, _ in found)
    got = {(d, round(s, 9)) for d, _, _, s in found}
    assert len(want) > 100 and got == want, f"{len({d for d, _ in want} - {d for d, _ in got})} of {len(want)} missed"


def test_leaks_of_every_kind_of_edit():
    """Substitutions, insertions, deletions and other words at both ends, from 8 to 400 words: windows place every pair at the threshold or above, with the similarity of its best run."""
    r, rule = random.Random(5), decontaminate.LeakRule()
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    total = 0
    for n, kind in itertools.product((8, 12, 20, 35, 60, 100, 200, 400), ("substitute", "insert", "delete", "ends")):
        items, docs, want = [], [], {}
        for _ in range(40):
            words = fresh(n)
            text, edits = list(words), r.randint(1, max(1, (n - 4) // 40))
            for _ in range(edits if kind != "ends" else 0):
                p = r.randrange(len(text))
                text[p : p + (kind != "insert") * r.choice([1, 1, 2])] = fresh(r.choice([1, 1, 2]) if kind == "insert" else kind == "substitute")
            if kind == "ends":
                lo, hi = r.randint(0, n // 12), r.randint(0, n // 12)
                text = fresh(lo) + text[lo : n - hi] + fresh(hi)
            text = fresh(r.choice([0, 9])) + text + fresh(r.choice([0, 9]))
            own, m = {tuple(words[i : i + 5]) for i in range(n - 4)}, n - 4
            known = np.append(0, np.cumsum([tuple(text[i : i + 5]) in own for i in range(max(0, len(text) - 4))]))
            best = 0.0
            for at in range(1 - m, len(known) - 1):
                lo, hi = max(0, at), min(len(known) - 1, at + m)
                best = max(best, (known[hi] - known[lo]) / (hi - lo + m - known[hi] + known[lo]))
            if best >= rule.similarity:
                want[len(items)] = round(float(best), 9)
            items.append(" ".join(words))
            docs.append(" ".join(text))
        found = {d: round(s, 9) for d, i, _, s in decontaminate.ItemIndex(list(enumerate(items)), rule).hits(TextBlock(pa.array(docs), fold=True)) if d == i}
        assert found == want, (n, kind)
        total += len(want)
    assert total > 500


# secrets

KEY = "Zx9Kq2Lm8Np4Rt7Vw3Yb6Hc1Jd5Fg0Ws"
PATTERNS = (("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 1), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0))


def test_secrets(spark):
    texts = ["é token = 'abcdefgh1' x", "secret: token: abcdefgh", f"key {KEY} end", "password=short PASSWD: longenough1", "AKIA1234567890AB AKIAAKIA", "a" * 40 + "0123456789abcdef" * 3, "path/to/some/file1/with/words2/in/it", "123e4567-e89b-12d3-a456-426614174000", None, "", "plain text", "api_key='x y' apikey=\"q1w2e3r4t5\""]
    data = list(enumerate(texts))
    got = {r["doc_id"]: r for r in secrets.secret_digests(frame(spark, data)).collect()}
    for i, t in data:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m.group(g)) >= n)
        base = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert got[i]["n_assign"] == sum(k == 0 for _, k, _ in spans)
    assert got[2]["spans"] == f"entropy:4:{4 + len(KEY)}"
    assert all("entropy" not in got[i]["spans"] for i in (6, 7, 8, 9, 10))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, data)).collect()}
    assert clean[2] == "key [SECRET] end" and clean[10] == "plain text" and clean[8] is None and clean[0] == "é [SECRET]' x"
    odd = secrets.scan_secrets(everything(spark).withColumn("secret_spans", F.lit(1)))
    assert odd.count() == len(ODD) and secrets.secret_digests(nothing(spark)).count() == 0


def test_secrets_behind_long_paths_and_around_base_spans(spark):
    path, inner = "some/letters/" * 6, "0123456789abcdef" * 2
    other = KEY[::-1]
    texts = [f"x {path}{KEY} y", f"é {KEY}/{inner}/{other} y", f"{'44/' * 25}{KEY}", f"{KEY}+token=abcdefgh1", "letters/" * 12, f"docs/{inner}/some/file2/with/words/in"]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(frame(spark, enumerate(texts))).collect()}
    spans = {i: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].split(",") if s)] for i in got}
    kinds = {i: [k for k, _, _ in spans[i]] for i in spans}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, enumerate(texts))).collect()}
    assert all(KEY not in clean[i] and other not in clean[i] for i in clean)
    assert kinds == {0: ["entropy"], 1: ["entropy", "hex", "entropy"], 2: ["entropy"], 3: ["entropy", "assign"], 4: [], 5: ["hex"]}
    assert spans[1] == [("entropy", 2, 3 + len(KEY)), ("hex", 3 + len(KEY), 35 + len(KEY)), ("entropy", 35 + len(KEY), 36 + 2 * len(KEY))]


def entropy(text):
    return -sum(c / len(text) * np.log2(c / len(text)) for c in Counter(text).values())


def test_sliding_entropy_equals_brute_force(spark):
    r, rule = random.Random(4), secrets.EntropyRule()
    values = ["".join(r.choice("abcdefABCDEF0123456789+/xyzXYZ") for _ in range(r.randint(24, 60))) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets._hot_stretch(F.col("v"), rule).alias("h"))
    for row in df.collect():
        v = row["v"]
        limit = next((n for _, p, n in rule.classes if re.match(p, v)), 99.0) - 1e-9
        hot = [i for i in range(len(v) - 23) if entropy(v[i : i + 24]) >= limit]
        assert (row["h"]["first"], row["h"]["last"]) == ((hot[0], hot[-1]) if hot else (None, None))


def brute_spans(text, rule):
    """All spans by plain code: base matches, then windows of what these leave of every candidate."""
    base = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(PATTERNS) for m in p.finditer(text) if len(m.group(g)) >= n)
    counts = lambda v: len(v) >= rule.window and all(re.search(p, v) for p in rule.needs) and not any(re.search(p.replace("++", "+"), v) for p in rule.allow)
    spans = [(a, k, b) for a, k, b in base]
    for m in re.finditer(rule.candidate, text):
        if not counts(m.group()):
            continue
        free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, _, b in base)]
        runs = [[i for _, i in g] for _, g in itertools.groupby(enumerate(free), lambda x: x[1] - x[0])]
        for run in runs:
            v = text[run[0] : run[-1] + 1]
            limit = next((n for _, p, n in rule.classes if re.match(p, v)), None)
            if not counts(v) or limit is None:
                continue
            hot = [i for i in range(len(v) - rule.window + 1) if entropy(v[i : i + rule.window]) >= limit - 1e-9]
            if hot:
                spans.append((run[0] + hot[0], 3, run[0] + hot[-1] + rule.window))
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_all_spans_equal_brute_force(spark):
    r, rule = random.Random(11), secrets.EntropyRule()
    key = lambda n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-": "".join(r.choice(chars) for _ in range(n))
    bits = [lambda: key(r.randint(20, 70)), lambda: key(r.randint(30, 50), "0123456789abcdef"), lambda: key(40, "0123456789"), lambda: key(30, "aab1"), lambda: "token=" + key(12), lambda: "AKIA" + key(16, "ABCDEFGH0123"), lambda: "docs/some/path1/file_name", lambda: "some-long-words-joined-by1-marks2", lambda: "plain words é ", lambda: "example" + key(30), lambda: key(24)]
    texts = ["".join(r.choice(bits)() + r.choice([" ", "", "/", ".", "\n"]) for _ in range(r.randint(1, 6))) for _ in range(150)]
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_digests(frame(spark, enumerate(texts))).collect()}
    wrong = [(t, got[i], brute_spans(t, rule)) for i, t in enumerate(texts) if got[i] != brute_spans(t, rule)]
    assert not wrong and sum("entropy" in x for x in got.values()) > 30


def test_a_megabyte_of_key_characters(spark):
    """Time is linear in a run's length: one inlined image, and a path of very many parts, don't hold up a task."""
    r = random.Random(12)
    image = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1 << 20))
    docs = frame(spark, [(1, f"data {image} end"), (2, "some/part1/" * 100_000)]).repartition(2)
    began = time.time()
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_digests(docs).collect()}
    assert got[1].startswith("entropy:5:") and got[1].endswith(f":{5 + (1 << 20)}") and got[2] == "" and time.time() - began < 60


def test_many_matches_in_one_text(spark):
    """Spans over the edges of blocks equal brute force, also where kinds overlap; a text with 100,000 matches takes seconds."""
    r, rule = random.Random(13), secrets.EntropyRule()
    key = lambda n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-": "".join(r.choice(chars) for _ in range(n))
    bits = [lambda: "token=abcdefgh1", lambda: key(32, "0123456789abcdef"), lambda: "secret: " + key(34, "0123456789abcdef"), lambda: "passwd=AKIA" + key(16, "AB01"), lambda: key(40), lambda: "é"]
    texts = ["".join(r.choice(bits)() + r.choice("\n ./G") for _ in range(n)) for n in (127, 128, 129, 257, 700)]
    digests = {x["doc_id"]: x["spans"] for x in secrets.secret_digests(frame(spark, enumerate(texts))).collect()}
    assert [digests[i] == brute_spans(t, rule) for i, t in enumerate(texts)] == [True] * len(texts)
    clean = {x["doc_id"]: x["text"] for x in secrets.redact_secrets(frame(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        at, out = 0, []
        for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in digests[i].split(","))):
            out += [t[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        assert clean[i] == "".join(out) + t[at:]
    many = "\n".join(["token=abcdefgh1"] * 100_000)
    base = ",".join(f"assign:{16 * i}:{16 * i + 15}" for i in range(100_000))
    began = time.time()
    row = secrets.secret_digests(frame(spark, [(1, many)])).collect()[0]
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and row["spans"] == base and time.time() - began < 40
    assert secrets.redact_secrets(frame(spark, [(1, many)])).collect()[0]["text"] == "\n".join(["[SECRET]"] * 100_000)


# pipeline


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Repeated rows, nulls and extra columns, and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("odd", [*ODD, *((100 + i, prose(i, 60)) for i in range(40))]), ("none", [])):
        folder = tmp_path / name
        frame(spark, rows).coalesce(2).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, prose(2000, 20))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = pipeline.run(spark, str(folder))
        assert {"doc_id", "ids_sha256"} <= set(out.columns) and (out.count() > 0) == bool(rows)


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "sentencepiece"]
