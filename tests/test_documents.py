"""Session documents written line by line are read back as they were."""

import json
import tempfile

from pyspark.sql import functions as F

from handtrace.sources import recordings as rec


def test_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, n in (("one", 400), ('two "quoted" }', 150)):
        events = [{"t": 5.0 * (i // 2), "type": "key_press" if i % 5 else "mouse_move", "key": 'a"},{' if i % 5 else None, "x": i, "y": 0}
                  for i in range(n)]
        doc = {"session_id": name, "player": "ann", "game": "g", "sensitivity": 1.5, "dpi": 800, "duration_ms": 90_000.0,
               "recorded_at": "2024-01-01T10:00:00Z", "event_count": n, "events": events, "activity": None}
        with open(f"{folder}/{n}.json", "w") as f:
            json.dump(doc, f)
    sessions, events, bad = rec.read_sessions(spark, folder)
    assert sessions.count() == 2 and bad.count() == 0
    rec.write_documents(sessions, events.repartition(5, F.rand(1)), f"{folder}/out")
    files = spark.read.text(f"{folder}/out", wholetext=True)
    assert files.count() == 2 and all(json.loads(r["value"])["events"] for r in files.collect())
    again, back, bad = rec.read_sessions(spark, f"{folder}/out", pattern="*/*.txt")
    assert bad.count() == 0
    names = [c for c in events.columns if c != "session_id"]
    assert sorted(map(str, back.select("session_id", *names).collect())) == sorted(map(str, events.select("session_id", *names).collect()))
    kept = [c for c in sessions.columns if c != "source_file"]
    assert sorted(map(str, again.select(kept).collect())) == sorted(map(str, sessions.select(kept).collect()))


def test_no_events_and_strangers(spark):
    """A session without events has an empty list; events without a session are not written."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sessions = spark.createDataFrame([("a", "p"), ("b", "q")], "session_id string, player string")
    kinds = "session_id string, seq long, t double, event_type string, x int, y int, dx int, dy int, button string, pressed boolean, key string"
    events = spark.createDataFrame([(s, i, 1.0 * i, "mouse_move", i, 0, None, None, None, None, None) for s in "bz" for i in (2, 0, 1)], kinds)
    rec.write_documents(sessions, events, f"{folder}/out")
    docs = {d["session_id"]: d for d in (json.loads(r["value"]) for r in spark.read.text(f"{folder}/out", wholetext=True).collect())}
    assert set(docs) == {"a", "b"} and docs["a"]["events"] == []
    assert [e["x"] for e in docs["b"]["events"]] == [0, 1, 2]
