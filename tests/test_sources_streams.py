import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources import files, game
from tidemark.streaming import sessions


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/index.md").write_text("# A\ntext")
    (tmp_path / "b.md").write_text("é")
    (tmp_path / "c.txt").write_text("no")
    assert {tuple(r) for r in files.read_markdown(spark, str(tmp_path)).collect()} == {("a/index.md", "# A\ntext"), ("b.md", "é")}


def test_questions_and_payloads(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# note\n\n{"question": "q", "type": "numeric", "value": 3}\n')
    assert [(r["question"], r["value"]) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("q", 3.0)]
    (tmp_path / "p.jsonl").write_text('{"champion": "x", "lane": "top", "patch": "1", "data": {"counters": [{"champion_name": "Zac", "play": 5, "win": 2}]}}\n[1]\nplain\n')
    good, bad = files.read_payloads(spark, str(tmp_path / "p.jsonl"), files.COUNTERS)
    assert [tuple(r) for r in files.counter_table(good).collect()] == [("x", "top", "1", 0, "Zac", 5, 2)] and bad.count() == 2


def test_game_tables(spark, tmp_path):
    spell = {"name": "S", "description": "a<br>b {{ x }}", "cooldown": [9, 8], "cost": [1], "range": [2], "maxrank": 2, "cooldownBurn": "9/8", "costBurn": "1"}
    (tmp_path / "c.json").write_text(json.dumps({"data": {"Garen": {"name": "Garen", "title": "t", "passive": {"name": "P", "description": "&lt;ok&gt;"}, "spells": [spell]}}}))
    raw = files.read_json(spark, str(tmp_path / "c.json"), files.CHAMPIONS)
    assert [(r["champion_id"], r["slot"], r["description"], r["cooldown"]) for r in game.abilities(raw, "1").collect()] == [("Garen", "Q", "a b", [9.0, 8.0])]
    assert game.champions(raw, "1").first()["tags"] == []
    assert {r["heading_path"]: r["content"] for r in game.champion_prose(raw).collect()} == {"Garen > Passive: P": "Garen — Passive: P. <ok>", "Garen > S (Q)": "Garen — S (Q). a b Cooldown 9/8s · cost 1 · range ?."}
    things = {"1": {"name": "A", "gold": {"total": 5}, "maps": {"11": True}}, "2": {"name": "B", "gold": {"total": 0}, "maps": {"11": True}}, "3": {"name": "C", "gold": {"total": 5}, "maps": {"12": True}}}
    (tmp_path / "i.json").write_text(json.dumps({"data": things}))
    assert [r["id"] for r in game.items(files.read_json(spark, str(tmp_path / "i.json"), files.ITEMS), "1").collect()] == ["1"]


@pytest.mark.parametrize("name", ["game_champions", "champion_prose", "game_items", "rune_prose", "summoner_prose"])
def test_one_row_group_is_many_tasks_work(spark, tmp_path, name):
    """Documents of a table in one row group are made and parsed by many tasks."""
    rows = spark.range(400).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'B#1' AS p_brand", "'T' AS p_type", "cast(id % 50 AS int) AS p_size", "900.0D + id AS p_retailprice")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [y for i, x in enumerate(plan) if "RepartitionByExpression" in x for y in plan[i + 1 : i + 3] if len(y) - len(y.lstrip(" :+-")) > len(x) - len(x.lstrip(" :+-"))]
    assert below and not any("json" in y for y in below)
    assert found.groupBy(F.spark_partition_id()).count().count() >= 4


def test_admission_counts_admitted_hits_only():
    admitted, wait, _ = sessions.admit(np.array([0.0, 1, 2, 3, 61]), [], 60, 2)
    assert list(zip(admitted.tolist(), wait.tolist(), strict=True)) == [(True, 0), (True, 0), (False, 59), (False, 58), (True, 0)]


def test_admission_equals_a_plain_count():
    r = random.Random(3)
    times = np.array(sorted(round(r.uniform(0, 300), 1) for _ in range(400)))
    kept, want = [], []
    for now in times:
        kept = [t for t in kept if t >= now - 20]
        want.append(len(kept) < 5)
        kept += [now] if want[-1] else []
    found, hits = [], []
    for i in range(0, 400, 37):
        some, _, hits = sessions.admit(times[i : i + 37], hits, 20, 5)
        found += some.tolist()
    assert found == want and 0 < sum(want) < 400


def turns():
    base = {"corpus": "game", "patch": "1", "own": None, "carried": None, "named": [], "referential": True, "more": False, "answered": ["Yone"]}
    first = base | {"ts": 1, "own": {"kind": "counters", "a": "Jax", "position": "top", "direction": "strong"}}
    return [first, base | {"ts": 100, "more": True, "answered": ["Zac"]}, base | {"ts": 150, "named": ["Darius"], "answered": None}, base | {"ts": 200, "more": True, "answered": None}, base | {"ts": 900, "answered": None}]


def rows(spark):
    return spark.createDataFrame([("s", n, json.dumps(t)) for n, t in enumerate(turns())], "session_id string, turn long, body string")


def test_followups(spark):
    found = sessions.followups(rows(spark)).orderBy("turn").collect()
    assert [r["kind"] for r in found] == ["counters", "counters", None, "counters", None]
    assert found[1]["exclude"] == ["Yone"] and found[3]["exclude"] == ["Yone", "Zac"] and found[1]["a"] == "Jax" and found[1]["position"] == "top"


def drain(spark, frame, name):
    frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(once=True).start().awaitTermination(60)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"k{i % 3}", i, 1_000.0 + i) for i in range(40)], "key string, seq long, ts double")
    events.write.parquet(str(tmp_path / "e"))
    stream = sessions.stream_admissions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), 10, 2)
    assert {tuple(r) for r in drain(spark, stream, "adm").collect()} == {tuple(r) for r in sessions.admissions(events, 10, 2).collect()}


def test_the_answers_lane_is_carried():
    first = turns()[0] | {"own": {"kind": "counters", "a": "Jax", "position": None, "direction": "strong"}, "lane": "mid"}
    frame, intent = sessions.resolve_turn(None, first)
    assert intent.position is None and frame.intent.position == "mid"
    _, again = sessions.resolve_turn(frame, turns()[1])
    assert again.position == "mid" and again.exclude == ["Yone"]
    named = first | {"own": first["own"] | {"position": "top"}}
    assert sessions.resolve_turn(None, named)[0].intent.position == "top"


def streamed_followups(spark, folder, parts, late, files=1):
    """Follow-ups of turns that come in `parts`, one trigger each, and then something long after them."""
    schema = "session_id string, turn long, body string"
    for part in [*parts, [("end", 0, json.dumps(turns()[4] | {"ts": 10_000_000}))]]:
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in", mode="append")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    sink = sessions.stream_followups(source, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return sorted(map(str, spark.read.schema(sessions.FOLLOWUPS).parquet(f"{folder}/out").filter("session_id <> 'end'").collect()))


def session_turns(sessions_, shift=0):
    """Several sessions of the same turns; the second turn of each comes twice, with one number and time."""
    out = [(s, n, json.dumps(t | {"ts": t["ts"] + shift})) for s in sessions_ for n, t in enumerate(turns())]
    return out + [(s, 1, json.dumps(turns()[1] | {"ts": turns()[1]["ts"] + shift})) for s in sessions_]


def test_shuffled_turns_over_triggers_equal_the_batch(spark, tmp_path):
    rows = session_turns(["a", "b", "c"])
    random.Random(5).shuffle(rows)
    want = sessions.followups(spark.createDataFrame(rows, "session_id string, turn long, body string"))
    assert streamed_followups(spark, tmp_path, [rows[k::5] for k in range(5)], "1 hour") == sorted(map(str, want.collect()))


def test_a_replay_with_pauses_equals_the_batch_and_frames_end_by_event_time(spark, tmp_path):
    """Every trigger ends with an event of another session hours later: by the clock no frame would be old, by the events' times the first session's are, before its next turn comes."""
    first, second = session_turns(["a"], 100_000), session_turns(["b"], 200_000)
    rows = sorted(first + second, key=lambda r: json.loads(r[2])["ts"])
    want = sessions.followups(spark.createDataFrame(rows, "session_id string, turn long, body string"))
    got = streamed_followups(spark, tmp_path, [[r] for r in rows], "0 seconds", files=3)
    assert got == sorted(map(str, want.collect()))


def test_stream_keeps_a_window_over_triggers(spark, tmp_path):
    """Batches minutes apart in processing time, hits within the window of each other by their own times."""
    schema, folder = "key string, seq long, ts double", tmp_path / "e"
    folder.mkdir()
    stream = sessions.stream_admissions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), 3600, 2)
    for k in range(4):
        spark.createDataFrame([("a", k, 600.0 * (k + 9)), (f"other{k}", k, 600.0 * (k + 9))], schema).coalesce(1).write.parquet(str(folder), mode="append")
        time.sleep(0.1)
    stream.writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {r["seq"]: r["admitted"] for r in spark.table("win").filter("key = 'a'").collect()} == {0: True, 1: True, 2: False, 3: False}


def test_stream_ingest_merges_batches_of_one_slice(spark, tmp_path):
    schema, source, out = "corpus string, doc_version string, doc_key string, content string", str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("c", "1", "a", "old"), ("c", "1", "b", "b")], [("c", "1", "a", "new"), ("d", "1", "a", "d")], []]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source, mode="append")
        sessions.stream_ingest(spark.readStream.schema(schema).parquet(source), lambda df: df, out, str(tmp_path / "check")).awaitTermination(120)
    found = {(r["corpus"], r["doc_key"], r["content"]) for r in spark.read.parquet(out).collect()}
    assert found == {("c", "a", "new"), ("c", "b", "b"), ("d", "a", "d")}


def test_log(spark):
    line = json.dumps({"event": "ask", "latency_ms": {"embed": 1, "retrieve": 2, "rerank": 3, "generation": 4, "total": 10}})
    found = sessions.parse_log(spark.createDataFrame([(line,), ("plain",), (None,)], "value string")).collect()
    assert [(r["total_ms"], r["total_ok"]) for r in found] == [(10.0, True)]
