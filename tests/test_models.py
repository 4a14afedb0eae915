"""Class weights, ablation, permutation importance and batch scoring on a table with known structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handtrace.operators import models as md

NAMES = ["strong", "weak", "noise"]


@pytest.fixture(scope="module")
def windows(spark):
    """Two players; ``strong`` separates them, ``weak`` hardly, ``noise`` not at all."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        b = i % 4 == 0
        rows.append((i, "b" if b else "a", float(rng.normal(4.0 * b)), float(rng.normal(0.5 * b)), float(rng.normal()) if i % 9 else None))
    df = spark.createDataFrame(rows, "row long, player string, strong double, weak double, noise double").cache()
    return df.where("row < 300"), df.where("row >= 300")


@pytest.mark.parametrize("kind", ["forest", "boosted", "logistic", "linear_svc"])
def test_class_weights_reach_every_kind(windows, kind):
    """With balanced weights the rare player is not left out when the feature hardly separates."""
    train, test = windows
    rare = train.where("player = 'a' or row % 20 = 0")
    model = md.fit_identifier(rare, ["weak"], kind=kind)
    share = md.identify(model, test, ["weak"]).agg(F.avg((F.col("y_pred") == "b").cast("double"))).first()[0]
    assert share > 0.2


def test_one_class_gives_no_model(windows):
    assert md.fit_identifier(windows[0].where("player = 'a'"), NAMES) is None


def test_ablation(windows):
    groups = {"good": ["strong"], "poor": ["weak", "noise"]}
    got = {r["group"]: r for r in md.feature_ablation(*windows, groups, "player", seeds=(1, 2)).collect()}
    assert set(got) == {"good", "poor"} and got["poor"]["n_features"] == 2
    assert got["good"]["only_accuracy"] > 0.9 > got["good"]["leave_out_accuracy"]
    for r in got.values():
        assert r["drop_cost"] == pytest.approx(r["full_accuracy"] - r["leave_out_accuracy"])
    assert got["good"]["only_accuracy"] == pytest.approx(got["poor"]["leave_out_accuracy"])
    assert got["good"]["drop_cost"] > 0.1 > abs(got["poor"]["drop_cost"])


@pytest.mark.parametrize("slices", [1, 3])
def test_permutation_importance(windows, slices):
    """All columns in one pass equal shuffling one column at a time."""
    train, test = windows
    model = md.fit_identifier(train, NAMES)
    got = {r["feature"]: r for r in md.permutation_importance(
        model, test, NAMES, NAMES, "b", "player", "row", seed=3, slices=slices, repeats=2).collect()}
    assert set(got) == set(NAMES) and got["strong"]["auc_drop"] > 0.2 and abs(got["noise"]["auc_drop"]) < 0.1
    from handtrace.operators.metrics import roc_auc
    drops = []
    for i in range(2):
        aucs = []
        for df in (test, md.permute_column(test, "strong", "row", 3 + i)):
            s = md.identify(model, df, NAMES).select(
                F.element_at("proba", F.lit("b")).alias("score"), (F.col("player") == "b").alias("positive"), F.lit(1).alias("g"))
            aucs.append(roc_auc(s, ["g"]).first()["auc"])
        drops.append(aucs[0] - aucs[1])
    assert got["strong"]["auc_drop"] == pytest.approx(np.mean(drops))


def test_batch_scores(windows):
    train, test = windows
    odd = test.limit(1).withColumns({"row": F.lit(9999).cast("long"), "strong": F.lit(60.0), "noise": F.lit(-50.0)})
    got = md.score_windows(md.fit_identifier(train, NAMES), train, test.unionByName(odd), NAMES, "row").collect()
    assert len(got) == 101 and all(set(r["proba"]) == {"a", "b"} for r in got)
    assert all(sum(r["proba"].values()) == pytest.approx(1) for r in got)
    by_row = {r["row"]: r for r in got}
    assert by_row[9999]["is_anomaly"] and by_row[9999]["anomaly_score"] == max(r["anomaly_score"] for r in got)
    assert 0 < np.mean([r["is_anomaly"] for r in got]) < 0.3


def test_permutation_pairs_are_dealt_and_scored_once(windows, monkeypatch):
    """Few bytes are long work here: the pairs go to tasks by their number, one pass whatever the repeats."""
    train, test = windows
    model = md.fit_identifier(train, NAMES)
    monkeypatch.setattr(md, "PAIRS_A_TASK", 50, raising=False)
    got = md.permutation_importance(model, test, NAMES, NAMES, "b", "player", "row", repeats=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 6), REPARTITION_BY_NUM" in plan  # 100 rows, 3 repeats
    assert plan.count("Window [row_number()") == 2 and "isnotnull(UDF" not in plan


def test_classes_are_not_gathered_for_their_weights(windows, spark):
    """Rows of a class stay in all their tasks; the classes of one model are fitted side by side."""
    train, _ = windows
    dealt = train.repartition(6).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = md.with_balance(dealt, "player").persist()
        held = rows.groupBy("player", F.spark_partition_id()).count().groupBy("player").count().collect()
        rows.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["player"]: r["count"] for r in held} == {"a": 6, "b": 6}
    assert all(md._estimator(kind, 7).getParallelism() > 1 for kind in ("boosted", "logistic", "linear_svc"))
