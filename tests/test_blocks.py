"""Blocked cross-correlation, bounded grid cells, session trials and mean vectors against plain computations."""

import random

import numpy as np
import pytest

from handtrace.operators import joins, metrics as m, stats as st


def plain_products(a, b, lag):
    def unit(series):
        v = np.array(list(series.values()))
        c = v - v.mean()
        return None if len(v) < 2 or not (c**2).sum() else dict(zip(series, c / np.sqrt((c**2).sum())))

    x, y = unit(a), unit(b)
    out = {}
    for i, u in (y or {}).items():
        for j, w in (x or {}).items():
            if abs(j - i) <= lag:
                out[j - i] = out.get(j - i, 0.0) + u * w
    return out


@pytest.mark.parametrize("lag", [0, 5, 70, 200])
def test_lagged_products(spark, lag):
    """Series of several blocks, with gaps, of unequal lengths, constant, and with a NULL key."""
    rng = random.Random(lag)
    sides = []
    for side in (0, 1):
        rows = [(k, i, rng.gauss(0, 1)) for k, n in (("s", 300 + 150 * side), (None, 90), ("short", 3)) for i in range(n)
                if k != "s" or i % 7]
        rows += [("flat", i, 2.0) for i in range(20)] + [("only one side", i, float(i)) for i in range(5 * side)]
        sides.append(rows)
    frames = [spark.createDataFrame(rows, "session_id string, i int, v double").repartition(3) for rows in sides]
    got = {}
    for r in joins.lagged_products(*frames, ["session_id"], lag).collect():
        got.setdefault(r["session_id"], {})[r["lag"]] = r["corr"]
    want = {}
    for k in ("s", None, "short", "flat"):
        found = plain_products(*[{i: v for key, i, v in rows if key == k} for rows in sides], lag)
        if found:
            want[k] = found
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    for k, by_lag in want.items():
        for x, corr in by_lag.items():
            assert got[k][x] == pytest.approx(corr, abs=1e-9)


def test_grid_in_cells(spark, monkeypatch):
    monkeypatch.setattr(st, "GRID_CELL", 3)
    rows = [("a", 0.0, 1.0), ("a", 10.0, 5.0), ("a", 10.2, 7.0), ("b", 4.0, 2.0)]
    got = st.resample(spark.createDataFrame(rows, "session_id string, s double, v double"), ["session_id"], 1.0).collect()
    grid = {(r["session_id"], r["i"]): (r["grid_s"], r["v"]) for r in got}
    assert len(got) == 12 + 2 and grid["a", 0] == (0.0, 1.0) and grid["a", 10] == (10.0, 6.0) and grid["a", 5] == (5.0, 0.0)
    assert grid["b", 0] == (4.0, 2.0) and grid["b", 1] == (5.0, 0.0)


def test_session_trials(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 4}", "ab"[i % 4 % 2], {"a": rng.random(), "b": rng.random()} | ({"c": 0.5} if i % 3 else {})) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, player string, proba map<string,double>")
    got = {(r["session_id"], r["claimed"]): r for r in m.session_trials(df, "player", ["a", "b", "c"]).collect()}
    assert len(got) == 12
    for (s, c), r in got.items():
        own = [x for x in rows if x[0] == s]
        assert r["score"] == pytest.approx(np.mean([p.get(c, 0.0) for _, _, p in own]))
        assert r["positive"] == any(t == c for _, t, _ in own)


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), (None, [5.0, 5.0])], "k string, v array<float>")
    assert {r["k"]: r["centroid"] for r in m.vector_means(df, ["k"], "v").collect()} == {"a": [2.0, 4.0], None: [5.0, 5.0]}
