import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stem import porter
from tidemark.functions.text import norm_name, words
from tidemark.operators import evaluate, ingest, lookups, matchups, roster, slices, snapshots
from tidemark.plans import questions
from tidemark.sources import lines


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "controlling": "control", "adoption": "adopt", "generalizations": "gener"}
    assert {w: porter(w) for w in words} == words


def test_norm_name(spark):
    rows = spark.createDataFrame([("Kai'Sa",), ("Dr. Mundo's",), ("Nunu & Willump",), (None,)], "n string").select(norm_name(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["kaisa", "dr mundo", "nunu willump", None]


def test_canonical_rows_do_not_depend_on_order(spark):
    rows = [("Garen", "Garen"), ("Jade_Garen", "Garen"), ("MasterYi", "Master Yi"), ("Jade_MasterYi", "Master Yi"), ("MonkeyKing", "Wukong"), ("Jade_MonkeyKing", "Wukong"), ("3075", "Thornmail"), ("323075", "Thornmail")]
    for k in (0, 3, 5):
        df = spark.createDataFrame([(*r, "1") for r in rows[k:] + rows[:k]], "id string, name string, patch string")
        assert {r["id"] for r in roster.canonical(df).filter("kept").collect()} == {"Garen", "MasterYi", "MonkeyKing", "3075"}


def test_champions_of_one_name_don_t_multiply(spark):
    """3,000 champions of one name and 3,000 questions on it: no join gives more rows than are asked."""
    champions = spark.range(3_000).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("patch"), F.lit("Ash").alias("name"))
    asked = spark.range(3_000).select(F.col("id").alias("query_id"), F.lit("p").alias("patch"), F.when(F.col("id") % 3 == 0, "ASH").when(F.col("id") % 3 == 1, F.col("id").cast("string")).otherwise("nobody").alias("champion"))
    found = lookups.champion_ids(asked, champions)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(i, ("0", str(i), None)[i % 3]) for i in range(3_000)}
    plan, most = [found._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.metrics().contains("numOutputRows") and "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        inside = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        plan += [inside] if inside is not None else [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 3_000


def test_questions_are_linked_once_for_all_branches(spark, sf_dir):
    assert "posexplode" not in questions.structured_answers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_stat_value(spark):
    rows = ["20 Attack Damage 18% Armor Penetration", "55 Attack Damage 18 Lethality", "10 Armor", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    assert [r[0] for r in df.select(lookups.stat_value(F.col("d"), "armor penetration")).collect()] == ["18% armor penetration", "18 lethality", None, None, None]


def test_stat_line(spark):
    rows = [("a", "1", "A", "Energy", {"hp": 500.0, "hpperlevel": 90.5, "mp": 200.0}), ("b", "1", "B", "None", {"hp": 1.0, "mp": 3.0})]
    df = spark.createDataFrame(rows, "id string, patch string, name string, partype string, stats map<string,double>")
    assert [r["line"] for r in lookups.stat_line(df).orderBy("id").collect()] == ["health 500 (+90.5/lvl); energy 200. Resource: Energy.", "health 1. No mana or secondary resource."]


def test_matchup_sides_and_status(spark):
    rows = [("x", "top", i, n, p, w) for i, (n, p, w) in enumerate([("Zac", 50, 19), ("Warwick", 38, 14), ("Lee Sin", 210, 99), ("Even", 100, 50), ("Rengar", 104, 62), (None, 5, 1), ("No", 0, 0), ("Null", None, 1)])]
    rated = matchups.rates(spark.createDataFrame(rows, "champion string, lane string, row_no int, opponent string, play long, win long"))
    found = {(r["side"], r["place"]): (r["opponent"], r["my_rate"]) for r in matchups.top(rated).collect()}
    assert found == {("weak", 1): ("Zac", 38.0), ("weak", 2): ("Lee Sin", 47.1), ("strong", 1): ("Rengar", 59.6)}
    seen = spark.createDataFrame([("x", "top", " ZAC ")], "champion string, lane string, opponent string")
    assert [r["opponent"] for r in matchups.next_page(rated, seen).filter("side = 'weak'").collect()] == ["Lee Sin"]
    asked = spark.createDataFrame([("x", "top", n) for n in ("warwick", "Lee Sin", "Teemo")], "champion string, lane string, opponent string")
    heads = {r["asked"]: (r["my_rate"], r["thin"], r["found"]) for r in matchups.head_to_head(rated, asked).collect()}
    assert heads == {"warwick": (36.8, True, True), "Lee Sin": (47.1, False, True), "Teemo": (None, False, False)}


def test_head_to_head_equals_brute_force(spark):
    r = random.Random(3)
    name = lambda n: "".join(r.choice("abé ") for _ in range(n))
    facts = [("A", r.choice(["top", "mid"]), i, f" {name(r.randint(1, 6))}Z", r.choice([10, 100]), r.randint(1, 9)) for i in range(120)]
    rated = matchups.rates(spark.createDataFrame(facts, "champion string, lane string, row_no int, opponent string, play long, win long"))
    asked = {("A", r.choice(["top", "mid", "none"]), r.choice([name(r.randint(1, 3)), name(5) + "z", r.choice(facts)[3].upper()])) for _ in range(150)} | {("A", "top", None), ("A", "top", " "), ("A", "mid", "abc" * 9)}
    got = {(x["champion"], x["lane"], x["asked"]): (x["opponent"], x["play"], x["thin"], x["found"]) for x in matchups.head_to_head(rated, spark.createDataFrame(list(asked), "champion string, lane string, opponent string")).collect()}
    assert set(got) == asked
    for champion, lane, want in asked:
        near = [] if want is None else sorted((f[3].strip(" ").lower() != want.strip(" ").lower(), f[2], f[3], f[4]) for f in facts if f[:2] == (champion, lane) and want.strip(" ").lower() in f[3].strip(" ").lower())
        assert got[champion, lane, want] == ((near[0][2], near[0][3], near[0][3] < matchups.FLOOR, True) if near else (None, None, False, False))


def test_complete(spark):
    df = spark.createDataFrame([(0.5, 0.1, 1, 2, ["top"]), (None, 0.1, 1, None, [])], "win_rate double, pick_rate double, tier int, rank int, roles array<string>")
    assert [(r["accepted"], r["missing"]) for r in matchups.complete(df, "stats").collect()] == [(True, []), (False, ["win_rate", "rank"])]
    assert [r["accepted"] for r in matchups.complete(df, "role").collect()] == [True, False]


def test_clean_markdown(spark):
    cases = {
        "a <b>bold</b>  x\n<!-- c -->\n\n\n\n<script>no</script>y <value>\n```\n<b>kept</b>  z\n```\n<br>": ("a bold x\n\ny <value>\n```\n<b>kept</b>  z\n```\n ", 7),
        "\n\n  - a   b\t\n\n\n": ("  - a b", 0),
        "x\r\n~~~ y\n<i>\n```\n ~~~~\n<i>z": ("x\n~~~ y\n<i>\n```\n ~~~~\n z", 1),
        "```\nopen <b>\n\n": ("```\nopen <b>\n", 0),
        "\n```\nx\n```\n\n": ("\n```\nx\n```\n", 0),
        "": ("", 0),
        None: ("", 0),
    }
    docs = spark.createDataFrame([(k,) for k in cases], "text string").withColumn("was", F.col("text"))
    assert {r["was"]: (r["text"], r["removed"]) for r in ingest.clean_documents(docs).collect()} == cases


def test_includes_of_rows_that_share_a_key(spark):
    directive = "{* a.py *}"
    docs = spark.createDataFrame([("k", f"x\n{directive}"), ("k", f"y\n{directive}\n{{* b.py *}}"), ("k", f"x\n{directive}"), ("k", "plain")], "doc_key string, text string")
    files = spark.createDataFrame([("a.py", "1\n")], "path string, body string")
    found = sorted(tuple(r) for r in ingest.resolve_includes(docs, files).collect())
    block = "```python\n1\n```"
    assert found == [("k", "plain", 0, 0), ("k", f"x\n{block}", 1, 0), ("k", f"x\n{block}", 1, 0), ("k", f"y\n{block}", 1, 1)]


def test_words_of_any_script(spark):
    row = spark.createDataFrame([("Straße 12, naïve Привет 日本 हिन्दी",)], "t string").select(words(F.col("t"))).first()
    assert row[0] == ["straße", "12", "naïve", "привет", "日本", "हिन्दी"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, None)], "id int, embedding array<float>")
    good, bad = ingest.split_vectors(df, 2)
    assert [r["id"] for r in good.collect()] == [1] and {r["id"]: r["reason"] for r in bad.collect()} == {2: "all zero", 3: "width", 4: "not finite", 5: "missing"}


def test_embedder_contract(spark):
    df = spark.createDataFrame([("", ""), ("h", "x" * 30_000)], "heading_path string, content string")
    out = ingest.embed(df, lambda: lambda texts: [[len(t), ord(t[0])] for t in texts])
    assert [list(r["embedding"]) for r in out.collect()] == [[1.0, 32.0], [24_000.0, 104.0]]


def test_slices_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "corpus string, doc_version string, content string"
    slices.replace_slices(spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], schema), path)
    for _ in range(2):
        slices.replace_slices(spark.createDataFrame([("a", "1", "z")], schema), path)
    assert {(r["corpus"], r["content"]) for r in spark.read.parquet(path).collect()} == {("a", "z"), ("b", "y")}
    with pytest.raises(ValueError):
        slices.replace_slices(spark.createDataFrame([], schema), path)


def test_patch_tables_fill_empty_collections(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", None, None)], "patch string, id string, stats map<string,double>, tags array<string>")
    slices.replace_patch({"items": rows}, str(tmp_path))
    got = snapshots.read(spark, str(tmp_path), "items").first()
    assert got["stats"] == {} and got["tags"] == []


def model(texts):
    return [[float(len(t)), float(ord(t[-1])), 1.0] for t in texts]


def slices_of_chunks(spark, n=60):
    rows = [("a" if i % 3 else None, "1" if i % 2 else "2", i, "h", "x" * (i % 17 + 1) + chr(97 + i % 26)) for i in range(n)]
    return spark.createDataFrame(rows, "corpus string, doc_version string, chunk_id long, heading_path string, content string")


def test_pairing_check_finds_a_shuffled_slice(spark):
    chunks = slices_of_chunks(spark)
    good = ingest.embed(chunks, lambda: model)
    other = good.select((F.col("chunk_id") + 6).alias("chunk_id"), F.col("embedding").alias("moved"))
    one = F.col("corpus").isNull() & (F.col("doc_version") == "2")
    spoilt = good.join(other, "chunk_id", "left").withColumn("embedding", F.when(one, F.col("moved")).otherwise(F.col("embedding"))).drop("moved")
    for stored, bad in ((good, set()), (spoilt, {(None, "2")})):
        found = ingest.pairing_report(stored, lambda: model, 4).collect()
        assert {(r["corpus"], r["doc_version"], r["n"]) for r in found} == {(c, v, 4) for c in ("a", None) for v in "12"}
        assert {(r["corpus"], r["doc_version"]) for r in found if not r["ok"]} == bad
    plan = ingest.slice_samples(chunks, 4)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_refused_batches_don_t_stop_the_others_and_a_second_run_embeds_what_is_missing(spark, tmp_path):
    chunks, seen = slices_of_chunks(spark), str(tmp_path / "v")
    stored, refused = ingest.embed_missing(chunks, lambda: flaky, seen, 6, 3)
    why = {r["batch_id"]: (r["reason"].split(":")[0], r["n"]) for r in refused.collect()}
    assert why == {1: ("RuntimeError", 6), 3: ("5 vectors came back for 6 inputs", 6), 5: ("not finite", 6), 7: ("width", 6), 9: ("all zero", 6)}
    assert stored.count() == 30
    again, none = ingest.embed_missing(chunks, lambda: model, seen, 6, 3)
    assert again.count() == 30 and none.count() == 0
    whole = ingest.stored_vectors(spark, seen, "chunk_id long").filter("reason is null")
    assert whole.count() == whole.select("chunk_id").distinct().count() == 60
    assert ingest.embed_missing(chunks, lambda: model, seen, 6, 3)[0].count() == 0


def flaky(texts):
    """By a batch's first text: chunk 6, 18, 30, 42 and 54."""
    out = model(texts)
    first = texts[0].rsplit("\n", 1)[-1][-1]
    if first == chr(97 + 6):
        raise RuntimeError("busy")
    return {chr(97 + 18): out[:-1], chr(97 + 4): [[float("nan")] * 3, *out[1:]], chr(97 + 16): [out[0][:2], *out[1:]], chr(97 + 2): [[0.0] * 3, *out[1:]]}.get(first, out)


def test_counters_are_those_of_the_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([("a", "1", "x", "p\nq\nr", 2), ("a", "1", "y", "s", 1), ("b", "1", "z", "t\nu", 0)], "corpus string, doc_version string, doc_key string, text string, removed long")
    lines = lambda d: d.select("corpus", "doc_version", "doc_key", F.explode(F.split("text", "\n")).alias("content"))
    assert ingest.ingest_slices(docs, lines, folder) == {"documents": 3, "removed": 3, "chunks": 6, "replaced": 0}
    assert snapshots.read(spark, folder, "chunks").count() == 6
    assert ingest.ingest_slices(docs.filter("doc_key = 'x'"), lines, folder) == {"documents": 1, "removed": 2, "chunks": 3, "replaced": 4}
    assert snapshots.read(spark, folder, "chunks").count() == 5
    with pytest.raises(ValueError):
        ingest.ingest_slices(docs.filter("false"), lines, folder)
    assert snapshots.read(spark, folder, "chunks").count() == 5


def test_label_lines_keep_their_bytes_and_order(spark, tmp_path):
    old = ["# note {\"question\": \"n\", \"type\": \"numeric\", \"value\": 1}", "", '{"question":"n",  "value": 1, "type":"numeric"}', "  \t", '{"question": "m", "type": "multi_row", "items": ["b", "a"]}\r', '{"type": "numeric", "question": "é", "value": 2.5, "x": null}', "not json", '{"question": "p", "type": "prose", "value": 1}', '{"question": "gone", "type": "numeric", "value": 9}', "日本 last"]
    (tmp_path / "old.jsonl").write_bytes("\n".join(old).encode())
    fresh = spark.createDataFrame([("n", 1.0, None), ("é", 3.0, None), ("m", None, ["a", "c"]), ("p", 5.0, None)], "qid string, value double, items array<string>")
    read = lines.read_lines(spark, str(tmp_path / "old.jsonl"))
    ends = [sum(len(x.encode()) + 1 for x in old[:k]) for k in range(len(old))]
    assert [tuple(r) for r in read.orderBy("at").collect()] == list(zip(ends, old, strict=True))
    done = evaluate.refresh_lines(read, fresh)
    lines.write_lines(done, str(tmp_path / "new"))
    got = b"".join(p.read_bytes() for p in sorted((tmp_path / "new").glob("part-*"))).decode().split("\n")
    want = [*old]
    want[4], want[5] = '{"question": "m", "type": "multi_row", "items": ["a", "c"]}', '{"type": "numeric", "question": "é", "value": 3, "x": null}'
    assert got == [*want, ""] and done.filter("changed").count() == 2


def test_lines_of_many_splits(spark, tmp_path):
    rows = [f"{i}:" + "x" * (i * 37 % 101) for i in range(3_000)]
    (tmp_path / "f.txt").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = [r["line"] for r in lines.read_lines(spark, str(tmp_path / "f.txt")).orderBy("at").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == rows


def test_failure_families(spark):
    urls = ["https://d.x/notes/"] * 3 + ["https://d.x/ref/a"] * 2 + ["https://d.x/ref/b?q#f"] + ["https://d.x/guide/deep/er/page"] * 2 + [None, "https://d.x", "/rel/path", "https://d.x/guide/other"]
    wrong = spark.createDataFrame([("A" if i % 2 else "B", u) for i, u in enumerate(urls)], "config string, source_url string")
    got = {}
    for r in evaluate.failure_families(wrong, 3).collect():
        got[r["family"]] = got.get(r["family"], 0) + r["n"]
    assert got == {"/notes/": 3, "/ref/": 3, "/guide/": 3, "other": 3}
    assert sum(got.values()) == len(urls)


def test_exact_mcnemar(spark):
    cases = [(0, 0), (5, 5), (0, 6), (1, 9), (30, 12), (400, 300), (3_000_000, 3_004_000), (10, 4_000)]
    rows = spark.createDataFrame(cases, "b long, c long").select("b", "c", evaluate.mcnemar("b", "c").alias("p")).collect()
    for r in rows:
        n, least = r["b"] + r["c"], min(r["b"], r["c"])
        if n < 1_000:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(least + 1)) / 2**n)
            assert abs(r["p"] - want) < 1e-9 * max(want, 1e-3)
    assert 0.1 < rows[6]["p"] < 0.11 and rows[7]["p"] < 1e-300 or rows[7]["p"] == 0.0


def test_set_recall_moves_a_text_once(spark):
    """Recall against plain counting; and texts are not multiplied by the names that are looked for."""
    rows = [(1, "Ash and Oak", ["ash", "oak", "elm", "gone"], 0.5), (2, None, ["ash"], 0.0), (3, "ELM", ["elm", "elm", None], 0.5), (4, "ash", [], 0.5), (5, "oaken", ["Oak"], 0.9), (6, "x", None, 0.0)]
    answers = spark.createDataFrame(rows, "qid long, text string, items array<string>, min_recall double")
    vocabulary = spark.createDataFrame([("ash",), ("ash",), ("Oak",), ("oak",), ("elm",)], "name string")
    found = evaluate.set_recall(answers, vocabulary)
    assert {(r["qid"], r["recall"], r["passed"]) for r in found.collect()} == {(1, 0.5, True), (2, 0.0, True), (3, 0.5, True), (4, 0.0, False), (5, 1.0, True), (6, 0.0, True)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[i + 1] for i, x in enumerate(plan) if "Generate explode" in x]
    assert below and all("Project [" in x and "text#" not in x for x in below)


def test_gate_of_off_corpus_questions(spark):
    rankings = spark.createDataFrame([("r", 1, 1, 0.9), ("r", 2, 1, 0.1), ("r", 2, 6, 0.9), ("v", 1, 1, None)], "config string, qid long, rank int, score double")
    gates = evaluate.off_corpus_gates(rankings, spark.createDataFrame([(1,), (2,), (3,)], "qid long"), ["r", "v"], 0.5)
    assert {tuple(r) for r in gates.collect()} == {("r", 1, False), ("r", 2, True), ("r", 3, True), ("v", 1, False), ("v", 2, True), ("v", 3, True)}


THREE = ("champions", "abilities", "items")


def patch(spark, patches, state):
    rows = spark.createDataFrame([(p, f"{p}-{i}", state) for p in patches for i in range(3)], "patch string, id string, state string")
    return {name: rows for name in THREE}


def states(spark, folder, number=None):
    return [sorted({(r["patch"], r["state"]) for r in snapshots.read(spark, folder, name, number).collect()}, key=repr) for name in THREE]


def test_a_commit_that_stops_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    first = slices.replace_patch(patch(spark, ["1.10", None], "old"), folder)
    before = states(spark, folder)
    assert before == [[("1.10", "old"), (None, "old")]] * 3
    whole, written = snapshots.write_slices, []

    def stops(rows, folder, name, *more):
        if len(written) == 2:
            raise OSError("stopped")
        written.append(name)
        return whole(rows, folder, name, *more)

    monkeypatch.setattr(snapshots, "write_slices", stops)
    with pytest.raises(OSError):
        slices.replace_patch(patch(spark, ["1.10"], "new"), folder)
    assert written == ["champions", "abilities"] and states(spark, folder) == before and snapshots.latest(spark, folder) == first
    monkeypatch.undo()
    last = slices.replace_patch(patch(spark, ["1.10", "2.0"], "new"), folder)
    assert last == first + 1 and states(spark, folder) == [[("1.10", "new"), ("2.0", "new"), (None, "old")]] * 3
    assert states(spark, folder, first) == before
    data = {p.name for p in (tmp_path / "data" / "champions").iterdir()}
    assert len(data) == 3
    assert snapshots.expire(spark, folder) == [last]
    assert len(list((tmp_path / "data" / "champions").iterdir())) == 2 and states(spark, folder) == [[("1.10", "new"), ("2.0", "new"), (None, "old")]] * 3
    with pytest.raises(ValueError):
        snapshots.read(spark, folder, "champions", first)


def test_an_empty_table_fails_before_anything_is_written(spark, tmp_path):
    tables = patch(spark, ["1"], "old")
    with pytest.raises(ValueError):
        slices.replace_patch(tables | {"items": tables["items"].filter("false")}, str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_two_commits_from_one_snapshot(spark, tmp_path):
    folder = str(tmp_path)
    rows = patch(spark, ["1"], "old")["items"]
    entries = snapshots.write_slices(rows, folder, "items", ("patch",))
    assert snapshots.publish(entries, folder, 0) == 1
    with pytest.raises(RuntimeError):
        snapshots.publish(entries, folder, 0)
    (tmp_path / "snapshots" / "snapshot=2" / "_temporary").mkdir(parents=True)
    assert snapshots.publish(entries, folder, 1) == 3 and snapshots.read(spark, folder, "items").count() == 3


def test_linking(spark):
    words = spark.createDataFrame([("champion", "master yi", "MasterYi", "Master Yi", 1), ("champion", "yi", "MasterYi", "Master Yi", 2), ("champion", "ez", "Ezreal", "Ezreal", 3), ("item", "infinity edge", "Infinity Edge", "Infinity Edge", 4)], "kind string, norm string, entity_id string, name string, ord int")
    asked = spark.createDataFrame([(1, "master yis winrate with Infinity Edge"), (2, "how does freeze work"), (3, None)], "query_id long, query string")
    found = roster.mentions(asked, roster.link_entities(asked, words)).orderBy("query_id").collect()
    assert [([c["id"] for c in r["champions"]], r["items"]) for r in found] == [(["MasterYi"], ["Infinity Edge"]), ([], []), ([], [])]
