"""Hand-computable windows."""

import math

import pytest

from handtrace.operators import features as feat, windows as win

SCHEMA = ("session_id string, seq long, t double, event_type string, x int, y int, dx int, dy int, "
          "pressed boolean, key string")


def table(spark, rows):
    full = [("s", i, float(r.get("t", 0)), r["k"], r.get("x"), r.get("y"), r.get("dx"), r.get("dy"),
             r.get("pressed"), r.get("key")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def move(t, x, y, dx=1, dy=0):
    return dict(t=t, k="mouse_move", x=x, y=y, dx=dx, dy=dy)


def bank(spark, rows):
    w = win.anchored_windows(table(spark, rows))
    return sorted((r.asDict() for r in feat.raw_window_features(w).collect()), key=lambda r: r["window_idx"])


def test_straight_line(spark):
    row = bank(spark, [move(10 * i, i, 0) for i in range(50)])[0]
    assert row["mouse_curvature_mean"] == pytest.approx(0, abs=1e-5)
    assert row["path_efficiency"] == pytest.approx(1)
    assert row["speed_mean"] == pytest.approx(0.1)
    assert row["speed_std"] == pytest.approx(0, abs=1e-12)
    assert row["burst_rate"] == 0 and row["iki_mean"] is None


def test_right_angles(spark):
    steps = [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]
    row = bank(spark, [move(10 * i, x, y) for i, (x, y) in enumerate(steps)])[0]
    assert row["mouse_curvature_mean"] == pytest.approx(math.pi / 2)
    assert row["mouse_curvature_std"] == pytest.approx(0, abs=1e-9)


def test_gap_keeps_window_number(spark):
    rows = [move(100 * i, i, 0) for i in range(10)] + [move(60_000 + 100 * i, i, 0) for i in range(10)]
    assert [r["window_idx"] for r in bank(spark, rows)] == [0, 2]


def test_single_event_and_span_end(spark):
    assert bank(spark, [move(5, 1, 1)]) == []
    rows = [move(0, 0, 0), move(10, 1, 0), move(30_000, 2, 0)]
    assert [r["window_idx"] for r in bank(spark, rows)] == [0]


def test_three_windows(spark):
    assert len(bank(spark, [move(500 * i, i, 0) for i in range(131)])) == 3


def test_hold_needs_a_later_release(spark):
    rows = [dict(t=0, k="key_press", key="w"), dict(t=0, k="key_release", key="w"),
            dict(t=50, k="key_press", key="a"), dict(t=90, k="key_release", key="a"),
            dict(t=95, k="key_release", key="w")]
    row = bank(spark, rows)[0]
    # the first press meets the release at the same time (hold 0, dropped), not the later one
    assert row["hold_mean"] == pytest.approx(40)


def test_click_reaction_and_pressed_null(spark):
    rows = [dict(t=0, k="mouse_click", pressed=True, x=0, y=0), move(10, 0, 0),
            dict(t=40, k="mouse_click", pressed=True, x=3, y=4), dict(t=45, k="mouse_click", pressed=None, x=9, y=9)]
    row = bank(spark, rows)[0]
    assert row["click_reaction_mean"] == pytest.approx(30)
    assert row["inter_click_movement"] == pytest.approx(5)
    assert row["click_interval_mean"] == pytest.approx(40)


def test_arrow_keys_are_not_movement_keys(spark):
    rows = [dict(t=i * 10, k="key_press", key="Key.up") for i in range(5)]
    assert bank(spark, rows)[0]["wasd_rhythm"] is None
    assert bank(spark, rows)[0]["keystroke_periodicity"] == pytest.approx(0)


def test_sliced_bank_equals_plain(spark):
    rows = []
    for i in range(120):
        rows.append(move(i * 97 % 29_000, (i * 7) % 40, (i * 11) % 30, (i % 5) - 2, (i % 3) - 1))
        if i % 4 == 0:
            rows.append(dict(t=i * 131 % 29_000, k="key_press", key="wasde"[i % 5]))
            rows.append(dict(t=i * 137 % 29_000, k="key_release", key="wasde"[i % 5]))
        if i % 6 == 0:
            rows.append(dict(t=i * 139 % 29_000, k="mouse_click", pressed=i % 4 != 2, x=i, y=i))
    w = win.anchored_windows(table(spark, rows))
    plain = feat.raw_window_features(w).first().asDict()
    cut = feat.raw_window_features(w, slices=4).first().asDict()
    for name, value in plain.items():
        assert cut[name] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), name
