"""Scored, timed and JSON streams: independent of batch borders, bounded, without doubles after a failure."""

import json
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from handtrace.streaming import messages, online, scoring, sketch

MESSAGE = ("session_id string, seq long, type string, t double, x double, y double, dx double, dy double, "
           "pressed boolean, key string, sensitivity double, dpi double, polling_rate double")


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def event(session, seq, t, kind="mouse_move"):
    return (session, seq, kind, float(t), float(seq % 7), float(seq % 3), 1.0, float(seq % 2), None, None, None, None, None)


def told(session, seq, sensitivity=None, dpi=None, polling=None):
    return (session, seq, "__session__", *[None] * 7, sensitivity, dpi, polling)


def ending(session, seq):
    return (session, seq, "__end__", *[None] * 10)


def stream(spark, rows, parts, schema=MESSAGE, key=lambda r: r[1]):
    """The rows as a stream of ``parts`` micro-batches in the order of ``key``."""
    path, rows = folder(), sorted(rows, key=key)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return online.stream_table(spark, path, per_trigger=1)


DETECTORS = scoring.Detectors(
    lambda f: scoring.long_scores(f, {"rate": F.col("event_rate"), "speed": F.coalesce("speed_mean", F.lit(0.0))}),
    lambda c: scoring.long_scores(c.groupBy("session_id", "unit", "trigger_seq").agg(F.max("t").alias("m"), F.min("t").alias("n")),
                                  {"pace": F.col("m") - F.col("n")}),
    scoring.platt_calibration({"rate": (1.0, -1.0), "speed": (2.0, 0.0), "pace": (0.001, 0.0)}), ("rate", "speed"))


def session_rows():
    rows = [told("a", -1, 1.0, 800.0, 1000.0), told("a", 100, 4.0), told("a", 301, 2.0, 1600.0), told("a", 501, None, None, 500.0)]
    rows += [event("a", i if i < 100 else i + 1 if i < 300 else i + 2 if i < 499 else i + 3, 130.0 * i) for i in range(700)]
    rows += [event("b", i, 1000.0 * i + (200_000 if i > 20 else 0)) for i in range(40)] + [event("c", 5, 7.0)]
    return rows + [ending("a", 10_000), ending("b", 10_000), ending("c", 10_000), ending("d", 1)]


@pytest.fixture(scope="module")
def one_batch(spark):
    return scored(spark, 1)


def scored(spark, parts):
    got = scoring.run_scoring(stream(spark, session_rows(), parts), DETECTORS, folder(), chunk_len=64)
    rows = got.collect()
    found = {(r["session_id"], r["seq"]): r.asDict() for r in rows}
    assert len(found) == len(rows)
    return found


def test_snapshots(one_batch):
    """Counts, running values and risk of hand-checked triggers."""
    a = [v for (s, _), v in sorted(one_batch.items()) if s == "a"]
    assert [v["triggered_by"] for v in a].count("finalize") == 1 and a[-1]["triggered_by"] == "finalize"
    assert a[-1]["n_events"] == 700 and a[-1]["n_chunks"] == 10 and a[-1]["n_windows"] == 4
    first = a[0]
    assert first["triggered_by"] == "chunk" and first["n_windows"] == 0 and first["per_detector"]["rate"] == 0
    assert set(first["detector_logits"]) == {"pace"} and first["chunk_scores"] == {"pace": pytest.approx(63 * 130)}
    for v in one_batch.values():
        total = sum(v["detector_logits"].values()) + np.log(0.05 / 0.95)
        assert v["session_risk"] == pytest.approx(1 / (1 + np.exp(-total)))
    tops = [v["per_detector"]["rate"] for v in a]
    assert tops == sorted(tops)
    c = one_batch["c", 6]
    assert c["n_windows"] == 0 and c["detector_logits"] == {} and c["session_risk"] == pytest.approx(0.05)
    assert not any(s == "d" for s, _ in one_batch)  # no events, no snapshot


def test_settings_hold_from_their_place(one_batch):
    """One field of the pair changes nothing; the pair and the rate hold for units completed after them."""
    a = {v["seq"]: v for (s, _), v in one_batch.items() if s == "a" and v["triggered_by"] == "window"}
    plain, halved = sorted(a)[0], sorted(a)[-1]
    assert plain > 100 and a[plain]["per_detector"]["rate"] == pytest.approx(231 / 30)
    assert halved > 501 and a[halved]["per_detector"]["rate"] == pytest.approx(2 * 231 / 30, rel=0.02)


@pytest.mark.parametrize("parts", [3, 7])
def test_batch_borders_do_not_matter(spark, one_batch, parts):
    got = scored(spark, parts)
    assert set(got) == set(one_batch)
    for k, v in got.items():
        for name, value in v.items():
            want = one_batch[k][name]
            assert value == (pytest.approx(want) if isinstance(want, (float, dict)) else want), (k, name)


def test_session_ends_by_the_clock(spark):
    """An idle session closes without ``__end__``; its state goes, and messages after an end are counted."""
    start = datetime(2024, 1, 1)
    schema = MESSAGE + ", received timestamp"

    def at(row, minute):
        return (*row, start + timedelta(minutes=minute))

    rows = [at(event("idle", i, 1000.0 * i), i / 60) for i in range(40)]
    rows += [at(event("ended", i, 1000.0 * i), 1) for i in range(10)] + [at(ending("ended", 10), 2)]
    rows += [at(event("ended", 11 + i, 9000.0), 3) for i in range(3)]
    rows += [at(event("busy", i, 60_000.0 * i), i) for i in range(60)]
    out = folder()
    source = stream(spark, rows, 6, schema, key=lambda r: r[-1])
    online.run_online(source, out, f"{out}/state", idle="10 minutes", lateness="1 minute")
    units = spark.read.parquet(f"{out}/units")
    ends = {r["session_id"]: r["unit"] for r in units.where("kind = 'end'").collect()}
    assert ends == {"idle": 40, "ended": 10}
    closed = {r["session_id"]: r["unit"] for r in units.where("kind = 'closed'").collect()}
    assert closed == {"idle": 0, "ended": 3}
    assert units.where("session_id = 'idle' and kind = 'window'").select("unit").distinct().count() == 2
    state = spark.read.format("statestore").option("stateVarName", "session").load(f"{out}/state")
    assert [r["key"][0] for r in state.select("key").collect()] == ["busy"]


def test_without_events(spark):
    out = folder()
    online.run_online(stream(spark, [told("a", 1, 1.0, 1.0, 1.0), ending("a", 2), ending("a", 3)], 1), out, f"{out}/state")
    assert [r["kind"] for r in spark.read.parquet(f"{out}/units").collect()] == ["end"]


@pytest.mark.parametrize("order", ["random", "rising", "falling", "equal"])
def test_sketch(order):
    values = np.random.default_rng(1).lognormal(size=60_000)
    values = {"random": values, "rising": np.sort(values), "falling": np.sort(values)[::-1], "equal": np.ones(60_000)}[order]
    points = weights = np.zeros(0)
    for i, v in enumerate(values, 1):
        points, weights = sketch.add(points, weights, v)
        if i in (1, 2, 19, sketch.EXACT):
            assert sketch.quantile(points, weights, 0.95) == pytest.approx(np.percentile(values[:i], 95))
    assert len(points) <= sketch.EXACT and weights.sum() == len(values)
    found = sketch.quantile(points, weights, 0.95)
    low, high = np.mean(values < found), np.mean(values <= found)
    assert low - 0.005 <= 0.95 <= high + 0.005


BAD = {
    "json": ['{"session_id": "s", "seq"', "", "nope"], "object": ["[1]", '"text"', "3", "null"], "session": ["{}", '{"seq": 1}'],
    "order": ['{"session_id": "s"}'], "field:t": ['{"session_id": "s", "seq": 1, "t": "soon"}'],
    "field:pressed": ['{"session_id": "s", "seq": 1, "pressed": {"a": 1}}']}


def test_messages_are_split_once(spark):
    """Bad messages keep text and reason; a batch that fails after its write is replayed without doubles."""
    good = [json.dumps({"session_id": "s", "seq": i, "type": "mouse_move", "t": 1.5 * i, "extra": [1]}) for i in range(20)]
    good.append('{"session_id": "s", "seq": 20, "x": null, "t": 7}')
    path, out = folder(), folder()
    spark.createDataFrame([(v,) for v in good + [v for vs in BAD.values() for v in vs]], "value string").repartition(3).write.mode(
        "append").text(path)
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    failed = []

    def broken(batch, batch_id):
        messages.write_batch(batch, out, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        online.run_stream(messages.sorted_messages(raw), broken, f"{out}-state")
    messages.split_messages(raw, out, f"{out}-state")
    got = spark.read.parquet(out)
    assert sorted(r["seq"] for r in got.where("outcome = 'good'").collect()) == list(range(21))
    bad = {}
    for r in got.where("outcome = 'bad'").collect():
        bad.setdefault(r["reason"], []).append(r["body"])
        assert r["session_id"] is None
    assert {k: sorted(v) for k, v in bad.items()} == {k: sorted(v) for k, v in BAD.items()}


def test_null_message(spark):
    got = messages.sorted_messages(spark.createDataFrame([(None, 3)], "value string, seq int")).first()
    assert (got["reason"], got["body"], got["seq"]) == ("json", None, None)
