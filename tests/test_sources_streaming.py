"""Session JSON and CSV readers, and the online job against the batch bank."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from handtrace.operators import features as feat, quality as q, windows as win
from handtrace.sources import recordings as rec
from handtrace.streaming import online


def document(**changes):
    base = {
        "session_id": "s1", "player": " Ann ", "game": "Big Game", "sensitivity": 1.0, "dpi": 800,
        "recorded_at": "2024-01-01T10:00:00Z", "duration_ms": 300000.0, "event_count": 500,
        "events": [{"t": 10.0 * i, "type": "mouse_move", "x": i, "y": 0, "dx": 1, "dy": 0} for i in range(500)]}
    base.update(changes)
    return {k: v for k, v in base.items() if v is not None}


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_ingest_and_quarantine(spark, folder):
    docs = {
        "ok": document(), "missing": document(player=None), "wrong": document(sensitivity=1), "short": document(duration_ms=1000.0),
        "empty": document(events=[]), "few": document(events=document()["events"][:50]),
        "odd": document(session_id="s2", cheat_label="aimbot", events=document()["events"] + [{"t": 1.0, "type": "other"}]),
        "none": document(events=[{"t": 1.0, "type": "other"}] * 200)}
    for name, doc in docs.items():
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(doc, f)
    with open(f"{folder}/broken.json", "w") as f:
        f.write("{nope")
    sessions, events, bad = rec.read_sessions(spark, folder)
    errors = {r["source_file"]: r["errors"] for r in bad.collect()}
    assert errors == {
        "missing.json": ["missing:player"], "wrong.json": ["type:sensitivity"], "short.json": ["duration:short"],
        "empty.json": ["events:empty"], "few.json": ["events:few"], "none.json": ["events:unusable"], "broken.json": ["corrupt"]}
    got = {r["session_id"]: r for r in sessions.collect()}
    assert got["s1"]["player"] == "ann" and got["s1"]["game"] == "big_game" and not got["s1"]["is_cheat_session"]
    assert got["s2"]["is_cheat_session"]
    assert events.groupBy("session_id").count().collect()[0]["count"] == 500
    lenient = rec.read_sessions(spark, folder, strict_types=False)[0]
    assert lenient.count() == 3

    rec.write_tables(sessions, events, f"{folder}/tables")
    assert rec.read_table(spark, f"{folder}/tables/events", ["t"]).count() == 1000
    rec.write_documents(sessions, events, f"{folder}/back")
    again = spark.read.text(f"{folder}/back", wholetext=True)
    assert again.count() == 2


def test_pointer_corpora(spark, folder):
    import os
    os.makedirs(f"{folder}/a/user7")
    with open(f"{folder}/a/user7/session_1", "w") as f:
        f.write("record timestamp,client timestamp,button,state,x,y\n0.0,0.0,NoButton,Move,1,1\n"
                "0.1,0.1,Left,Pressed,1,1\n0.2,0.2,NoButton,Move,4,5\n0.3,0.3,Scroll,Down,4,5\n0.4,0.4,NoButton,Move,65535,1\n")
    assert rec.read_pointer_corpus_a(spark, f"{folder}/a/*/*").count() == 0  # too short
    rows = rec.read_pointer_corpus_a(spark, f"{folder}/a/*/*", min_rows=2)
    ev = {r["seq"] - min(x["seq"] for x in rows.collect()): r for r in q.pointer_events(rows).collect()}
    assert [ev[i]["event_type"] for i in sorted(ev)] == ["mouse_move", "mouse_click", "mouse_move", "mouse_scroll"]
    assert (ev[0]["dx"], ev[2]["dx"], ev[2]["dy"], ev[3]["dy"]) == (0, 3, 4, -1)
    assert ev[2]["t"] == pytest.approx(200) and rows.first()["user"] == "user7"
    os.makedirs(f"{folder}/b/user1")
    with open(f"{folder}/b/user1/x_3min.csv", "w") as f:
        f.write("client timestamp,button,state,x,y\n500,NoButton,Move,1,1\n700,NoButton,Move,2,1\n")
    got = rec.read_pointer_corpus_b(spark, f"{folder}/b/*/*").orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 200] and got[0]["protocol"] == "3min"


def messages(spark, events):
    rows = [("s", -1, "__session__", None, None, None, None, None, None, None, 2.0, 400.0, 500.0)]
    rows += [("s", i, *e, None, None, None) for i, e in enumerate(events)]
    rows += [("s", 10 ** 9, "__end__", *[None] * 10)]
    schema = ("session_id string, seq long, type string, t double, x double, y double, dx double, dy double, "
              "pressed boolean, key string, sensitivity double, dpi double, polling_rate double")
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("parts", [1, 5])
def test_online_equals_batch(spark, parts):
    ev = [("mouse_move", 100.0 * i, float(i * i % 17), float(i % 5), 1.0, 1.0, None, None) for i in range(450)]
    ev += [("key_press", 100_000.0 + 50 * i, None, None, None, None, None, "w") for i in range(40)]  # after an idle gap
    ev += [("mouse_move", 131_000.0, 3.0, 3.0, 1.0, 0.0, None, None), ("mouse_move", 131_500.0, 4.0, 3.0, 1.0, 0.0, None, None)]
    late = ev[:200] + [("mouse_move", 5.0, 0.0, 0.0, 0.0, 0.0, None, None)] + ev[200:]
    m = messages(spark, late)
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bound = 10 ** 9
    for i in range(parts):  # several files, several micro-batches
        lo, hi = -2 + i * 120, (-2 + (i + 1) * 120 if i < parts - 1 else bound + 1)
        m.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{out}/m")
    online.run_online(online.stream_table(spark, f"{out}/m", per_trigger=1), out, f"{out}/state")
    got = {r["window_idx"]: r.asDict() for r in spark.read.parquet(f"{out}/features").collect()}
    units = spark.read.parquet(f"{out}/units")
    end = units.filter("kind = 'end'").first()
    assert (end["late"], end["unit"]) == (1, len(ev))
    assert units.filter("kind = 'chunk'").select("unit").distinct().count() == len(ev) // 64

    batch = messages(spark, ev).filter("type not like '\\_\\_%'").withColumnRenamed("type", "event_type")
    meta = spark.createDataFrame(
        [("s", "p", "g", None, False, 2.0, 400, 500, None, None)],
        "session_id string, player string, game string, activity string, is_cheat_session boolean, "
        "sensitivity double, dpi int, polling_rate int, recorded_at timestamp, duration_ms double")
    want = {r["window_idx"]: r.asDict() for r in feat.window_features(batch, meta).filter("n >= 2").collect()}
    assert set(got) == set(want)
    for w, row in want.items():
        for name in feat.FEATURES:
            assert got[w][name] == (pytest.approx(row[name]) if row[name] is not None else None), (w, name)


def test_bad_messages_are_kept_apart(spark):
    raw = spark.createDataFrame([('{"session_id":"s","seq":1,"type":"mouse_move","t":1.0}',), ("{oops",), ("{}",)], "value string")
    good, bad = rec.parse_messages(raw)
    assert good.count() == 1 and bad.count() == 2


def test_report_sinks_and_folder_label(spark, folder):
    df = spark.createDataFrame([("f", 0.5), ("g", 1.5)], "feature string, psi double")
    rec.write_report_csv(df, f"{folder}/csv")
    rec.write_report_json(df, f"{folder}/json")
    want = sorted(map(tuple, df.collect()))
    back = spark.read.option("header", True).schema(df.schema).csv(f"{folder}/csv")
    assert sorted(map(tuple, back.collect())) == want
    assert sorted((r["feature"], r["psi"]) for r in spark.read.json(f"{folder}/json").collect()) == want
    paths = spark.createDataFrame([("/d/no_cheater_present/1.parquet",), ("/d/with_cheater_present/2.parquet",)], "p string")
    assert [r[0] for r in paths.select(rec.folder_label(F.col("p"))).collect()] == [0, 1]
