"""Labels, splits, statistics, metrics, risk and neighbours on small literals."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from handtrace.operators import joins, labels, metrics as m, models as md, outcome as oc
from handtrace.operators import risk as rk, sequence as sq, splits as sp, stats as st, windows as win


def test_toggle_open_span_runs_to_the_end(spark):
    ev = spark.createDataFrame(
        [("s", 0, 10.0, "key_press", "f8"), ("s", 1, 30.0, "key_press", "f8"), ("s", 2, 50.0, "key_press", "f8"),
         ("s", 3, 90.0, "mouse_move", None)], "session_id string, seq long, t double, event_type string, key string")
    got = sorted((r["start_ms"], r["end_ms"]) for r in labels.toggle_spans(ev, {"f8": "aimbot"}).collect())
    assert got == [(10.0, 30.0), (50.0, 90.0)]


@pytest.mark.parametrize("slices", [1, 4])
def test_interval_join_against_brute_force(spark, slices):
    rng = random.Random(5)
    ev = [("s", float(rng.randrange(200)), i) for i in range(80)]
    spans = [("s", float(a), float(a + rng.randrange(1, 40)), c) for c in ("a", "b") for a in rng.sample(range(180), 8)]
    got = {(r["seq"], r["cheat"]) for r in joins.interval_join(
        spark.createDataFrame(ev, "session_id string, t double, seq long"),
        spark.createDataFrame(spans, "session_id string, start_ms double, end_ms double, cheat string"), slices).collect()}
    want = {(i, c) for (_, t, i), (_, a, b, c) in itertools.product(ev, spans) if a <= t <= b}
    assert got == want


def test_chunk_label_tie_is_alphabetical(spark):
    members = spark.createDataFrame([("s", 0, i, float(i)) for i in range(4)], "session_id string, chunk_idx long, seq long, t double")
    spans = spark.createDataFrame([("s", 0.0, 1.0, "macro"), ("s", 2.0, 3.0, "aimbot")],
                                  "session_id string, start_ms double, end_ms double, cheat string")
    assert labels.chunk_labels(members, spans).first()["label"] == "aimbot"


@pytest.mark.parametrize("n,length,stride,want", [(128, 64, 64, 2), (128, 64, 32, 3), (63, 64, 64, 0), (64, 64, 64, 1), (100, 64, 32, 2)])
def test_chunk_counts(spark, n, length, stride, want):
    ev = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"))
    got = win.chunk_membership(ev, length, stride).groupBy("chunk_idx").count().collect()
    assert len(got) == want and all(r["count"] == length for r in got)


def test_split_invariants(spark):
    rows = [(f"s{i}", f"p{i % 3}", i % 7 == 6) for i in range(40)] + [("lonely", "px", False)]
    s = spark.createDataFrame(rows, "session_id string, player string, is_cheat_session boolean")
    got = sp.stratified_sessions(s, 0.2, 0.15, 2)
    assert sp.leaking_sessions(got).count() == 0
    seen = {(r["player"], r["fold"]) for r in got.collect()}
    assert seen == set(itertools.product(["p0", "p1", "p2"], ["train", "val", "test"]))


def test_two_sessions_keep_train(spark):
    s = spark.createDataFrame([("a", "p", False), ("b", "p", False)], "session_id string, player string, is_cheat_session boolean")
    assert sorted(r["fold"] for r in sp.stratified_sessions(s, 0.2, 0.15, 1).collect()) == ["test", "train"]


def test_psi_and_ks(spark):
    same = [("f", float(i % 50), c) for i in range(500) for c in (False, True)]
    moved = [("g", float(i % 50) + (30.0 if c else 0.0), c) for i in range(500) for c in (False, True)]
    flat = [("h", 1.0, c) for c in (False, True)]
    df = spark.createDataFrame(same + moved + flat, "feature string, value double, cur boolean")
    rep = {r["feature"]: r for r in st.drift_report(df, F.col("cur")).collect()}
    assert rep["f"]["psi"] == pytest.approx(0, abs=1e-9) and rep["f"]["psi_severity"] == "none"
    assert rep["g"]["ks_stat"] == pytest.approx(0.6) and rep["g"]["ks_drifted"]
    assert rep["g"]["psi_severity"] == "significant"
    assert rep["h"]["psi"] is None and rep["h"]["psi_severity"] == "unknown"


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    rows = [("d", float(rng.randrange(6)), rng.random() < 0.4) for _ in range(120)] + [("e", 1.0, True)]
    df = spark.createDataFrame(rows, "detector string, score double, positive boolean")
    got = {r["detector"]: r["auc"] for r in m.roc_auc(df, ["detector"], 3).collect()}
    pos = [s for d, s, p in rows if d == "d" and p]
    neg = [s for d, s, p in rows if d == "d" and not p]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got["d"] == pytest.approx(want) and got["e"] is None


def test_eer_separable_is_zero(spark):
    rows = [("k", s, s > 0.5) for s in (0.1, 0.2, 0.3, 0.7, 0.8, 0.9)]
    curve = m.threshold_counts(spark.createDataFrame(rows, "k string, score double, positive boolean"), ["k"])
    assert m.equal_error_rate(m.det_points(curve, ["k"]), ["k"]).first()["eer"] == pytest.approx(0)


def test_combined_risk_worked_examples(spark):
    rows = [("three", d, 0.9) for d in "abc"] + [("none", "a", None)]
    got = {r["session_id"]: r["risk"] for r in rk.combined_risk(
        spark.createDataFrame(rows, "session_id string, detector string, p double")).collect()}
    assert got["three"] == pytest.approx(0.975, abs=1e-3) and got["none"] == pytest.approx(0.05)


def test_isotonic_is_monotone_and_clipped(spark):
    rows = [(i, "d", i / 10, 1.0 if i > 5 else 0.0) for i in range(11)]
    s = spark.createDataFrame(rows, "i long, detector string, score double, label double")
    knots = rk.fit_isotonic(s).withColumn("detector", F.lit("d"))
    extra = spark.createDataFrame([(99, "other", 0.3, 0.0)], s.schema)
    got = {r["i"]: r["p"] for r in rk.apply_isotonic(s.unionByName(extra), knots).collect()}
    values = [got[i] for i in range(11)]
    assert values == sorted(values) and min(values) == 1e-3 and max(values) == 1 - 1e-3 and got[99] == 0.5


def test_clock_offset_recovers_injected_lag(spark):
    rng = random.Random(2)
    v = [rng.random() for _ in range(120)]
    demo = spark.createDataFrame([("s", i / 4, v[i]) for i in range(120)], "session_id string, s double, v double")
    rec = spark.createDataFrame([("s", i / 4, v[i + 12]) for i in range(100)], "session_id string, s double, v double")
    row = oc.clock_offsets(demo, rec, 4.0, 10.0).first()
    assert row["lag"] == 12 and row["offset_s"] == pytest.approx(3.0) and row["peak_corr"] > 0.8


def test_yaw_wraps(spark):
    a = spark.createDataFrame([("s", "p", 0, 0.0, 179.0), ("s", "p", 64, 0.0, -179.0)],
                              "session_id string, name string, tick long, pitch double, yaw double")
    assert oc.view_speed(a, 64.0).first()["angvel"] == pytest.approx(2.0)


def test_nearest_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = md.nearest(df.filter("id < 30"), df.filter("id >= 30"), 3, "id", "v", block_rows=17).collect()
    for i in range(30):
        want = np.sort(np.linalg.norm(x[30:] - x[i], axis=1))[:3]
        assert sorted(r["distance"] for r in got if r["id"] == i) == pytest.approx(list(want))


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a) for a in rng.normal(size=3)]) for i in range(300)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    top = md.isolation_forest(df, df, "id", "v", trees=30, sample=64).orderBy(F.col("score").desc()).first()
    assert top["id"] == 999


def test_normaliser_keeps_flat_channels(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = {r["channel"]: (r["mean"], r["std"]) for r in sq.fit_normaliser(df, ["a", "b"]).collect()}
    assert stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_range_aggregate_against_brute_force(spark):
    rng = random.Random(9)
    pts = [("s", float(rng.randrange(100)), float(i)) for i in range(60)]
    anchors = [("s", i, float(rng.randrange(100))) for i in range(20)]
    got = {r["seq"]: (r["points"], r["total"]) for r in joins.range_aggregate(
        spark.createDataFrame(anchors, "session_id string, seq long, anchor_t double"),
        spark.createDataFrame(pts, "session_id string, t double, v double"), 15.0, "v").collect()}
    for _, i, c in anchors:
        inside = [v for _, t, v in pts if c - 15 <= t <= c]
        assert got[i] == (len(inside), pytest.approx(sum(inside)))


def test_mann_whitney_direction(spark):
    rows = [("f", float(i), False) for i in range(30)] + [("f", float(i + 20), True) for i in range(30)]
    r = st.mann_whitney(spark.createDataFrame(rows, "feature string, value double, b boolean"), F.col("b")).first()
    assert r["effect"] < -0.5 and r["p_value"] < 0.001 and not math.isnan(r["u"])


def test_shares_are_decimal(spark):
    """floor(0.7 * 90) is 63; binary doubles give 62.99."""
    rows = spark.range(90).select(F.lit("s").alias("k"), "id")
    parts = {r["part"]: r["count"] for r in sp.temporal_split(rows, ["k"], ["id"]).groupBy("part").count().collect()}
    assert parts == {"train": 63, "test": 26}
