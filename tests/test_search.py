"""Search against plain code: both ways of the vector leg, stemmed and multilingual keywords, numbering, and the list of configurations."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions.stem import porter
from tidemark.functions.text import STOP_WORDS
from tidemark.operators import evaluate, index, pivots, search, snapshots
from tidemark.operators.lineage import cut, numbered
from tidemark.plans import tables


def test_both_ways_of_the_vector_leg(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(300)]
    vectors[7] = [0.0] * 6
    schema = "chunk_id long, embedding array<double>"
    chunks = spark.createDataFrame([*enumerate(vectors), (999, None)], schema)
    asked = chunks.filter("chunk_id % 20 = 7 or chunk_id = 999").withColumnRenamed("chunk_id", "query_id")
    unit = [np.array(v) / np.linalg.norm(v) if any(v) else None for v in vectors]
    want = {}
    for q in range(7, 300, 20):
        if unit[q] is not None:
            scores = sorted((-round(float(unit[q] @ u), 9), i) for i, u in enumerate(unit) if u is not None)
            want[q] = [i for _, i in scores[:5]]
    pruned = pivots.pruned_topk(asked, chunks, 5, pivots=8).rows
    for found in (pruned.withColumn("similarity", F.round("similarity", 9)), search.vector_topk(asked, chunks, 5)):
        rows = found.orderBy("query_id", "rank").collect()
        got = {q: [r["chunk_id"] for r in rows if r["query_id"] == q] for q in want}
        scores = {(r["query_id"], r["rank"]): round(r["similarity"], 9) for r in rows}
        assert {r["query_id"] for r in rows} == set(want)
        assert all(scores[q, k + 1] == round(float(unit[q] @ unit[i]), 9) for q, ids in want.items() for k, i in enumerate(ids))
        assert all(scores[q, k + 1] == round(float(unit[q] @ unit[i]), 9) for q, ids in got.items() for k, i in enumerate(ids))


def clustered(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, n)] + 0.15 * rng.normal(size=(n, 16))
    return x, spark.createDataFrame([(f"id-{i:05d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")


def test_pruning_leaves_out_products_and_no_answer(spark, monkeypatch):
    """String ids; groups so small that tiles and the queries of a tile are split over several."""
    monkeypatch.setattr(pivots, "GROUP_CHUNKS", 40)
    monkeypatch.setattr(pivots, "GROUP_QUERIES", 10)
    x, chunks = clustered(spark, 2_000)
    asked = chunks.filter("substr(chunk_id, 8, 1) = '7'").withColumnRenamed("chunk_id", "query_id")
    found = pivots.pruned_topk(asked, chunks, 6, pivots=24)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"id-{q:05d}", f"id-{i:05d}", k) for q in range(7, 2_000, 10) for k, i in enumerate(np.argsort(-(unit @ unit[q]), kind="stable")[:6], 1)}
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.rows.collect()} == want
    assert found.pairs == 200 * 2_000 and found.products < 0.25 * found.pairs


def test_pruning_with_few_rows_and_ties(spark):
    none = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    same = spark.createDataFrame([(c, [1.0, 0.0]) for c in "edcba"], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<double>")
    assert pivots.pruned_topk(asked, none, 3).rows.collect() == [] == pivots.pruned_topk(asked.filter("false"), same, 3).rows.collect()
    for rows in (pivots.pruned_topk(asked, same, 3).rows, search.vector_topk(asked, same, 3)):
        assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in rows.orderBy("rank").collect()] == [(1, "a", 1), (1, "b", 2), (1, "c", 3)]
    assert [r["chunk_id"] for r in pivots.pruned_topk(asked, same, 9).rows.orderBy("rank").collect()] == list("abcde")


def test_stemmed_search_equals_plain_code(spark):
    texts = ["Running runs ran", "the runner is running in the rain", "rain rains raining", "Страны и страна", "naïve rain, running", "", None, "running rain running"]
    asked = ["runs rained", "rain", "the of", "страна", "naïve"]
    words = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split() if w not in STOP_WORDS]
    bags = [Counter(map(porter, words(t))) for t in texts]
    want = set()
    for q, text in enumerate(asked):
        terms = {porter(w) for w in words(text)}
        hits = sorted((-sum(bag[t] for t in terms), i) for i, bag in enumerate(bags) if terms and all(bag[t] for t in terms))
        want |= {(q, i, -n, place) for place, (n, i) in enumerate(hits[:3], 1)}
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    assert {tuple(r) for r in search.keyword_topk(queries, chunks, 3).collect()} == want and want


def test_different_words_are_stemmed_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(search, "cut", lambda rows: rows)
    table = search.word_terms(spark.createDataFrame([("rains",), ("rains",), ("raining",), ("the",)], "word string"))
    assert {tuple(r) for r in table.collect()} == {("rains", "rain"), ("raining", "rain")} and "Join" not in table._jdf.queryExecution().optimizedPlan().toString()


CHUNKS = "corpus string, doc_version string, chunk_id string, content string"


def plain_bm25(rows, query, k, k1=1.2, b=0.75):
    """(chunk_id, score) of (corpus, version, chunk_id, content) rows by plain counting."""
    bags = [Counter(w for w in (r[3] or "").lower().split() if w not in STOP_WORDS) for r in rows]
    mean = sum(sum(x.values()) for x in bags) / len(rows)
    terms = {w for w in query.lower().split() if w not in STOP_WORDS}
    out = []
    for r, bag in zip(rows, bags, strict=True):
        if terms and all(bag[t] for t in terms):
            df = {t: sum(1 for x in bags if x[t]) for t in terms}
            out.append((-round(sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * sum(bag.values()) / mean)) for t in terms), 6), r[2]))
    return [(c, -s) for s, c in sorted(out)[:k]]


def test_kept_index(spark, tmp_path, monkeypatch):
    """Scores, ties and ranges against plain counting; small ranges so that many are skipped; a slice is replaced alone; only asked buckets are read."""
    monkeypatch.setattr(index, "BLOCK", 4)
    r, folder = random.Random(8), str(tmp_path)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(30)], k=r.randint(1, 25)))
    rows = [(c, v, f"{c}{v}-{i:03d}", text()) for c, v, n in (("a", "1", 150), ("a", "2", 60), (None, "1", 40)) for i in range(n)] + [("a", "1", "none", None), ("a", "1", "stops", "the of")]
    asked = [(1, "w0 w1"), (2, "w5"), (3, "w3 w20 w1"), (4, "the"), (5, "w29 missing"), (6, "w0")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    first = index.index_slices(spark.createDataFrame(rows, CHUNKS), folder, stem=False)

    def check(rows, skips, **scope):
        for score in (index.bm25, index.occurrences):
            found = index.search(queries, folder, 7, score, stem=False, **scope)
            got = {}
            for x in found.rows.orderBy("query_id", "rank").collect():
                got.setdefault(x["query_id"], []).append((x["chunk_id"], round(x["score"], 6)))
            if score is index.bm25:
                assert got == {q: want for q, text_ in asked if (want := plain_bm25(rows, text_, 7))}
            else:
                bags = {x[2]: Counter((x[3] or "").split()) for x in rows}
                for q, text_ in asked:
                    terms = set(text_.split()) - set(STOP_WORDS)
                    hits = sorted((-sum(bag[t] for t in terms), c) for c, bag in bags.items() if terms and all(bag[t] for t in terms))
                    assert got.get(q, []) == [(c, float(-n)) for n, c in hits[:7]]
            assert not skips or found.scored < found.asked

    check(rows, True)
    check([x for x in rows if x[0] == "a"], True, corpus="a")
    check([x for x in rows if x[:2] == ("a", "2")], False, corpus="a", doc_version="2")
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "data").rglob("*.parquet")}
    fresh = [("a", "2", f"new-{i}", text()) for i in range(30)]
    last = index.index_slices(spark.createDataFrame(fresh, CHUNKS), folder, stem=False)
    new = {str(p) for p in (tmp_path / "data").rglob("*.parquet")} - set(files)
    assert new and all("corpus=a/doc_version=2" in p for p in new) and all((tmp_path / p).stat().st_mtime_ns == t for p, t in files.items())
    check([x for x in rows if x[:2] != ("a", "2")] + fresh, True)
    check(rows, True, snapshot=first)
    assert last == first + 1
    one = spark.createDataFrame([("w7",)], "term string")
    read = index.asked_blocks(snapshots.read(spark, folder, "postings"), one)
    of = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert of == {str(one.select(index.bucket(F.col("term"))).first()[0])}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]


def test_stemmed_index_equals_stemmed_search(spark, tmp_path):
    texts = ["Running runs ran", "the runner is running in the rain", "rain rains raining", "naïve rain, running", "", None, "running rain running"]
    chunks = spark.createDataFrame([("c", "1", i, t) for i, t in enumerate(texts)], "corpus string, doc_version string, chunk_id long, content string")
    queries = spark.createDataFrame(list(enumerate(["runs rained", "rain", "the of", "naïve"])), "query_id long, query string")
    index.index_slices(chunks, str(tmp_path))
    got = {(r["query_id"], r["chunk_id"], int(r["score"]), r["rank"]) for r in index.search(queries, str(tmp_path), 3, index.occurrences).rows.collect()}
    assert got == {tuple(r) for r in search.keyword_topk(queries, chunks, 3).collect()} and got


def test_postings_move_twice_at_most(spark):
    """Words are counted where their text's range is: texts and blocks are shuffled, single words are not."""
    chunks = spark.createDataFrame([("c", str(i % 2), i, "a few words of rain") for i in range(20)], "corpus string, doc_version string, chunk_id long, content string")
    made = index.index_tables(chunks, stem=False)["postings"]
    moved = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x.replace("- Exchange", " Exchange")]
    assert len(moved) == 2 and "REPARTITION_BY_NUM" in moved[1] and "REBALANCE_PARTITIONS_BY_COL" in moved[0]


def test_a_range_and_bucket_is_one_row_on_the_move(spark, monkeypatch):
    """Blocks are shuffled packed: no more rows than ranges times buckets; rows of one id in a slice are one chunk."""
    monkeypatch.setattr(index, "BUCKETS", 2)
    rows = [("c", "1", i % 30, " ".join(f"w{j}" for j in range(i % 7, 40))) for i in range(60)]
    made = index.index_tables(spark.createDataFrame(rows, "corpus string, doc_version string, chunk_id long, content string"), stem=False)["postings"]
    got = {r["term"]: r for r in made.collect()}
    want = {f"w{j}": {c: 2 for c in range(30)} for j in range(6, 40)}
    assert {t: {e["chunk_id"]: e["tf"] for e in r["entries"]} for t, r in got.items() if t in want} == want and len(got) == 40
    assert {e["length"] for e in got["w39"]["entries"]} <= {n for n in range(67, 81)} and all(r["n"] == len(r["entries"]) and r["most"] == max(e["tf"] for e in r["entries"]) for r in got.values())
    plan = made._jdf.queryExecution().executedPlan()
    tree = plan.toString().split("== Initial Plan ==")[0]
    below = tree.split("REBALANCE_PARTITIONS_BY_COL", 1)[1]
    assert "terms#" in below.splitlines()[1] and "term#" not in below.splitlines()[1]


def test_a_search_of_many_terms_moves_asked_blocks_only(spark, tmp_path, monkeypatch):
    """Terms of any number up to those that are sent meet the postings where these are read."""
    monkeypatch.setattr(index, "PUSHED", 1)
    rows = [("c", "1", i, f"rain w{i}") for i in range(20)]
    index.index_slices(spark.createDataFrame(rows, "corpus string, doc_version string, chunk_id long, content string"), str(tmp_path), stem=False)
    asked = cut(spark.createDataFrame([("w3",), ("rain",), ("w5",)], "term string"))
    read = index.asked_blocks(snapshots.read(spark, str(tmp_path), "postings"), asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["term"] for r in read.collect()} == {"w3", "rain", "w5"}
    found = index.search(spark.createDataFrame([(1, "the")], "query_id long, query string"), str(tmp_path), 3, stem=False)
    assert found.rows.collect() == [] and (found.asked, found.scored) == (0, 0)


def test_pairs_of_query_and_chunk_stay_where_they_are(spark, tmp_path):
    """A search shuffles the asked blocks by their range, and then the best of each query; what is between them is not shuffled."""
    rows = [("c", "1", i, f"rain w{i}") for i in range(20)]
    index.index_slices(spark.createDataFrame(rows, "corpus string, doc_version string, chunk_id long, content string"), str(tmp_path), stem=False)
    found = index.search(spark.createDataFrame([(1, "rain"), (2, "w3 rain")], "query_id long, query string"), str(tmp_path), 3, index.occurrences, stem=False)
    moved = [x for x in found.rows._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x.replace("- Exchange", " Exchange")]
    assert len(moved) == 2 and "hashpartitioning(slice#" in moved[1] and "hashpartitioning(query_id#" in moved[0] and not any("chunk_id" in x for x in moved)
    assert {tuple(r)[:1] + tuple(r)[3:] for r in found.rows.collect()} == {(1, 0, 1.0, 1), (1, 1, 1.0, 2), (1, 2, 1.0, 3), (2, 3, 2.0, 1)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 10).alias("kind"), (F.col("id") * 37 % 1000).alias("x")).repartition(7)
    whole = [r["ord"] for r in numbered(rows, F.col("x")).orderBy("x").collect()]
    assert whole == list(range(1, 1001))
    found = numbered(rows, F.col("x"), by="kind").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("x", "ord"))).alias("o")).collect()
    assert len(found) == 10 and all([o["ord"] for o in r["o"]] == list(range(1, 101)) for r in found)


def test_every_configuration_is_scored(spark):
    names = [f"c{i}" for i in range(130)]
    ranked = spark.createDataFrame([(c, 1, 2, True) for c in names], "config string, qid long, rank int, right boolean")
    scores = evaluate.score_rankings(ranked, spark.createDataFrame([(1,), (2,)], "qid long"), names)
    assert scores.count() == 260 and scores.filter("hit_3 = 1 and rr = 0.5").count() == 130


def test_faithfulness(spark):
    judged = spark.createDataFrame([(1, "4/5"), (2, "no"), (3, "Score: 2"), (4, None), (5, "5")], "qid long, judge_text string")
    assert tuple(evaluate.faithfulness(judged).first()) == (5, 3, 11 / 3)
    assert [tuple(r) for r in evaluate.least_faithful(judged, 2).collect()] == [(3, 2), (1, 4)]


def test_contents_are_taken_apart_once_for_all_their_queries(spark, monkeypatch):
    """Scores are those of `overlap_score` on every pair, whether asked words are sent or joined; a content that many queries meet is taken apart once."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("rain snow wind fog ice sun hail".split(), k=rng.randint(1, 6))) for _ in range(12)] + [None, "", "snow ```"]
    bodies = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string").coalesce(1)
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["rain snow", "snow rain", "Rain rain", "fog", "", "sun hail the", "absent", None] * 5)], "query_id long, query string")
    pairs = queries.select("query_id").crossJoin(bodies.select("chunk_id").unionByName(spark.range(90, 92).select(F.col("id").alias("chunk_id"))))
    plain = pairs.join(queries, "query_id").join(bodies, "chunk_id")
    plain = plain.select("query_id", "chunk_id", search.overlap_score(F.col("query"), F.col("content")).cast("double").alias("score"), F.contains("content", F.lit("```")).alias("code"))
    want = sorted(map(tuple, plain.collect()))
    assert len(want) == 40 * len(texts)
    taken, words = spark.sparkContext.accumulator(0), search.words

    def counted(text):
        def seen(t):
            taken.add(1)
            return t

        return words(F.udf(seen, "string")(text)) if "content" in str(text) else words(text)

    monkeypatch.setattr(search, "words", counted)
    for sent in (search.SENT_TERMS, 0):
        monkeypatch.setattr(search, "SENT_TERMS", sent)
        before = taken.value
        got = search.overlap_scores(pairs.unionByName(pairs.limit(5)), queries, bodies)
        assert sorted(map(tuple, got.collect())) == want
        assert taken.value - before == len(texts)


def test_keywords_are_found_where_chunks_are(spark, monkeypatch):
    """Both ways of the keyword leg against plain counting, ids that repeat and long ids among them; the way that sends the asked terms makes no postings, and queries of the same terms are one search."""
    rng = random.Random(5)
    names = [f"w{i}x" for i in range(40)]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 60))) for _ in range(400)] + [None, "the of", "Straße w1x w1x"]
    asked = [" ".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(60)] + ["w1x w0x", "W0x w1x the", "the", "", None, "absent w0x", "straße"]
    rows = [(f"c{i % 390:04d}", t) for i, t in enumerate(texts)]
    bags = {}
    for i, t in rows:
        bags.setdefault(i, Counter()).update(w for w in (t or "").lower().split() if w not in STOP_WORDS)
    want = set()
    for q, text in enumerate(asked):
        terms = {w for w in (text or "").lower().split() if w not in STOP_WORDS}
        hits = sorted((-sum(bag[t] for t in terms), i) for i, bag in bags.items() if terms and all(bag[t] for t in terms))
        want |= {(q, i, -n, place) for place, (n, i) in enumerate(hits[:5], 1)}
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    postings, made = search.postings, []
    monkeypatch.setattr(search, "postings", lambda *a: made.append(a) or postings(*a))
    monkeypatch.setattr(search, "ROWS", 7)
    for most in (1 << 20, 50):
        monkeypatch.setattr(search, "MET", most)
        assert {tuple(r) for r in search.keyword_topk(queries, chunks, 5, stem=False).collect()} == want and not made
    numbers = chunks.withColumn("chunk_id", F.substring("chunk_id", 2, 4).cast("int"))
    assert {(r[0], f"c{r[1]:04d}", *r[2:]) for r in search.keyword_topk(queries, numbers, 5, stem=False).collect()} == want and not made
    monkeypatch.setattr(search, "SENT_TERMS", 3)
    assert {tuple(r) for r in search.keyword_topk(queries, chunks, 5, stem=False).collect()} == want and len(made) == 1
    lost = spark.createDataFrame([(None, "fog"), (None, "fog fog"), ("a", "fog")], "chunk_id string, content string")
    one = spark.createDataFrame([(1, "fog")], "query_id long, query string")
    monkeypatch.setattr(search, "SENT_TERMS", 9)
    assert {tuple(r) for r in search.keyword_topk(one, lost, 5, stem=False).collect()} == {(1, None, 3, 1), (1, "a", 1, 2)}


def test_tiles_are_sorted_until_k_are_held(monkeypatch):
    """The best of tiles are those of a full sort, ties and zero vectors among them; once k chunks are held, a tile is not ordered again but for what comes near them."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (600, 5)).astype(float)
    vectors[rng.integers(0, 600, 20)] = 0
    unit = search.unit_vectors(pa.array(vectors.tolist()))
    asked = unit[::10]
    partition, ordered = np.partition, []
    monkeypatch.setattr(np, "partition", lambda *a, **k: ordered.append(a) or partition(*a, **k))
    monkeypatch.setattr(search, "TILE", 50)
    best = search.Best(pa.array(range(60)), asked, 4, np.int64)
    for lo in range(0, 600, 120):
        best.meet(np.arange(lo, lo + 120), unit[lo : lo + 120])
    got = {}
    for r in best.rows(pa.int64()).to_pylist():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    score = np.full((60, 600), -np.inf)
    for i in range(0, 600, 50):
        score[:, i : i + 50] = np.nan_to_num(asked @ unit[i : i + 50].T, nan=-np.inf)
    want = {q: [int(c) for c in np.lexsort((np.arange(600), -np.round(score[q], 12)))[:4]] for q in range(60) if np.isfinite(asked[q]).all()}
    assert {q: [round(float(score[q, c]), 12) for c in ids] for q, ids in got.items()} == {q: [round(float(score[q, c]), 12) for c in ids] for q, ids in want.items()}
    assert len(ordered) <= 8


def test_only_documents_of_a_query_are_taken_apart(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(0, 70)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = {0: "wide Words of odd length, odd words", 20: None, 40: "b a", 60: "zebra", 80: "no vector", 100: "none here"}
    spark.createDataFrame([(i, texts.get(i, "other text")) for i in texts.keys() | {1, 2, 3}], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    taken, words = spark.sparkContext.accumulator(0), tables.words

    def seen(t):
        taken.add(t is not None)
        return t

    monkeypatch.setattr(tables, "words", lambda text: words(F.udf(seen, "string")(text)))
    got = {r["query_id"]: r["query"] for r in tables.questions(spark, str(tmp_path)).collect()}
    assert got == {0: "length wide", 20: "", 40: "", 60: "zebra"} and taken.value == 3
