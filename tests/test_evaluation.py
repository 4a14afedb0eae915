"""Drift and benchmark grids from shared counts, bootstraps, tails and NULL keys, against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from handtrace.functions.exprs import hashed
from handtrace.operators import metrics as m, risk as rk, stats as st


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("slices", [1, 4])
def test_drift_against_equals_one_report_per_target(spark, slices):
    rng = random.Random(2)
    rows = [(who, f, float(round(rng.gauss(0.4 * i, 1 + j), 1))) for i, who in enumerate(["base", "x", "y", None])
            for j, f in enumerate(["f", "g", None]) for _ in range(60 + 20 * i)]
    rows += [("x", "h", 1.0), ("base", "k", 2.0), ("base", "const", 3.0), ("y", "const", 4.0)]
    long = spark.createDataFrame(rows, "who string, feature string, value double")
    got = rows_of(st.drift_against(long, "who", "base", slices=slices), "target", "feature")
    assert {(t, f) for t, f in got} == {(t, f) for t in ("x", "y", None) for f in ("f", "g", None)} | {
        ("y", "const"), ("x", "h")}
    for target in ("x", "y", None):
        part = long.where((F.col("who") == "base") | F.col("who").eqNullSafe(F.lit(target)))
        want = rows_of(st.drift_report(part, F.col("who").isNull() | (F.col("who") != "base"), slices=slices), "feature")
        for (t, f), row in got.items():
            if t == target:
                for name, value in want[f,].items():
                    assert row[name] == (pytest.approx(value) if isinstance(value, float) else value), (t, f, name)


@pytest.mark.parametrize("slices", [1, 3])
def test_grid_from_shared_negatives(spark, slices):
    rng = random.Random(4)
    rows = [(d, lab, round(rng.gauss(0.8 * (lab != "legit"), 1), 1)) for d in ("one", "two", None)
            for lab in ("legit", "legit", "legit", "aim", "macro") for _ in range(40)]
    rows += [("no negatives", "aim", 0.5), ("no positives", "legit", 0.5), ("one", "never right", -9.0), ("one", "aim", None)]
    scores = spark.createDataFrame(rows, "detector string, label string, score double")
    got = rows_of(m.benchmark_grid(scores, slices=slices), "detector", "label")
    assert set(got) == {(d, lab) for d in ("one", "two", None) for lab in ("aim", "macro")} | {
        ("no negatives", "aim"), ("one", "never right")}
    assert got["no negatives", "aim"]["auc"] is None and got["no negatives", "aim"]["detection_rate"] is None
    assert got["one", "never right"]["auc"] == 0 and got["one", "never right"]["detection_rate"] == 0
    for (d, lab), row in got.items():
        pos = np.array([s for x, y, s in rows if (x, y) == (d, lab) and s is not None])
        neg = np.array([s for x, y, s in rows if (x, y) == (d, "legit")])
        assert (row["n_pos"], row["n_neg"]) == (len(pos), len(neg))
        if not len(neg):
            continue
        assert row["auc"] == pytest.approx(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))
        cuts = sorted({*pos, *neg})
        rates = [(pos >= c).mean() for c in cuts if (neg >= c).mean() <= 0.05]
        assert row["detection_rate"] == pytest.approx(max(rates, default=0.0))
        steps = [((pos == c).mean(), (pos >= c).sum() / ((pos >= c).sum() + (neg >= c).sum())) for c in cuts if (pos >= c).any()]
        assert row["ap"] == pytest.approx(sum(a * b for a, b in steps))
        assert (row["mean_cheat"], row["mean_legit"]) == (pytest.approx(pos.mean()), pytest.approx(neg.mean()))


def test_bootstrap_counts_equal_picked_rows(spark):
    """The confusion tables of the draws are those of the rows that the keyed places pick."""
    rng = random.Random(6)
    rows = [(d, i, rng.choice("abc"), rng.choice("abc"), rng.random()) for d in ("x", "y") for i in range(37)]
    df = spark.createDataFrame(rows, "detector string, id long, truth string, said string, score double")
    got = rows_of(m.bootstrap(df, 50, "truth", "said", "id", ["detector"]), "detector", "metric")
    picks = {(r["draw"], r["place"]): r["h"] for r in spark.range(50).select(F.col("id").alias("draw")).crossJoin(
        spark.range(37).select(F.col("id").alias("place"))).withColumn("h", hashed(F.col("draw"), F.col("place"))).collect()}
    for d in ("x", "y"):
        own = [r for r in rows if r[0] == d]
        accuracy, f1 = [], []
        for draw in range(50):
            drawn = [own[picks[draw, p] % 37] for p in range(37)]
            accuracy.append(np.mean([t == s for _, _, t, s, _ in drawn]))
            classes = {x for r in drawn for x in r[2:4]}
            f1.append(np.mean([2 * sum(t == c == s for _, _, t, s, _ in drawn)
                               / sum((t == c) + (s == c) for _, _, t, s, _ in drawn) for c in classes]))
        for metric, values in (("accuracy", accuracy), ("macro_f1", f1)):
            row = got[d, metric]
            assert row["draws"] == 50 and row["mean"] == pytest.approx(np.mean(values))
            assert (row["low"], row["high"]) == (pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)))


def test_bootstrap_without_groups(spark):
    df = spark.createDataFrame([(i, i % 2, 1 if i < 3 else i % 2, float(i), i % 2 == 1) for i in range(9)],
                               "id long, truth int, said int, score double, positive boolean")
    assert {r["metric"] for r in m.bootstrap(df, 5, "truth", "said", "id").collect()} == {"accuracy", "macro_f1"}
    assert m.bootstrap_auc(df, 5, "id").count() == 1


def test_chi_squared_tail_has_no_cap(spark):
    """Against the closed form for even degrees and the recurrence from two degrees below for all."""
    cases = [(x, k) for k in (1, 2, 3, 9, 12, 15, 50, 301, 2000) for x in (0.0, 0.3, k * 0.9, float(k), k * 1.2)]
    got = [r["p"] for r in spark.createDataFrame(cases, "x double, k int").coalesce(1).select(
        st.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()]

    def exact(x, k):
        if x == 0:
            return 1.0
        half, odd = x / 2, k % 2
        logs = [(i + odd / 2) * math.log(half) - math.lgamma(i + odd / 2 + 1) - half for i in range((k - odd) // 2)]
        return sum(map(math.exp, logs)) + (math.erfc(math.sqrt(half)) if odd else 0.0)

    for (x, k), p in zip(cases, got):
        assert p == pytest.approx(exact(x, k), rel=1e-9, abs=1e-14), (x, k)
    assert spark.range(1).select(st.chi2_tail(F.lit(1.0), F.lit(0))).first()[0] is None


def test_null_keys_stay(spark):
    rows = [(k, float(i % 13 + (i % 2) * (k is None)), i % 2 == 1) for k in ("a", None) for i in range(80)]
    df = spark.createDataFrame(rows, "feature string, value double, late boolean")
    for n in (1, 3):
        assert {r["feature"] for r in st.ks_statistic(df, F.col("late"), slices=n).collect()} == {"a", None}
        report = rows_of(st.drift_report(df, F.col("late"), slices=n), "feature")
        assert set(report) == {("a",), (None,)} and report[None,]["psi"] is not None
        scored = df.select(F.col("feature").alias("d"), F.col("value").alias("score"), F.col("late").alias("positive"))
        det = m.det_points(m.threshold_counts(scored, ["d"], n), ["d"])
        assert {r["d"] for r in m.equal_error_rate(det, ["d"], n).collect()} == {"a", None}
    risk = rk.combined_risk(spark.createDataFrame([("s", "d", 0.9), (None, "d", 0.2)], "session_id string, detector string, p double"))
    assert rows_of(risk, "session_id")[None,]["risk"] < 0.05 < rows_of(risk, "session_id")["s",]["risk"]
    series = spark.createDataFrame([(None, 0.0, 1.0), (None, 1.0, 3.0)], "session_id string, s double, v double")
    assert [r["v"] for r in st.resample(series, ["session_id"], 1.0).orderBy("i").collect()] == [1.0, 3.0]


def test_rates_per_detector(spark):
    rows = [(s, d, i, float(i * (1 + (d == "b"))), i > 7) for s in ("s", "t") for d in ("a", "b") for i in range(10)]
    units = spark.createDataFrame(rows, "session_id string, detector string, unit_idx long, score double, contains_cheat boolean")
    got = rows_of(rk.flag_rates(units, by=("detector",)), "session_id", "detector")
    assert len(got) == 4 and all(r["hit_rate"] == 1.0 for r in got.values())
    tops = rows_of(rk.alternative_rollups(units, 2, 5.0, keys=("session_id", "detector")), "session_id", "detector")
    assert tops["s", "a"]["top_mean"] == 8.5 and tops["s", "b"]["top_mean"] == 17.0
