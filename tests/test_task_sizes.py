"""Plans that kept too much in one task: rows of a feature in one place, one table ordered three times."""

import random

import pytest
from pyspark.sql import functions as F

from handtrace.operators import joins, stats as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_does_not_gather_a_feature(spark):
    rows = spark.createDataFrame([(f, float(i), i % 2 == 0) for f in "ab" for i in range(40)], "feature string, value double, late boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = st.common_histogram(rows, "late", 4)
        assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
        assert {(r["feature"], r["late"], r["bin"], r["n"]) for r in got.collect()} == {
            (f, late, b, 5) for f in "ab" for late in (True, False) for b in range(4)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("slices", [1, 3])
def test_range_within_one_table(spark, slices):
    rng = random.Random(9)
    rows = [("s", i, float(rng.randrange(60)), rng.choice("cmo"), rng.choice([None, float(i)])) for i in range(120)]
    events = spark.createDataFrame(rows, "session_id string, seq long, t double, kind string, x double")
    got = joins.range_aggregate_within(events, F.col("kind") == "c", F.col("kind") == "m", 9.0, "x", slices=slices)
    if slices == 1:
        assert plan(got).count("Scan ExistingRDD") == 1
    want = {}
    for _, seq, t, kind, _ in rows:
        if kind == "c":
            inside = [x for _, _, u, k, x in rows if k == "m" and t - 9.0 <= u <= t]
            want[seq] = (len(inside), pytest.approx(sum(x or 0.0 for x in inside)))
    assert {r["seq"]: (r["points"], r["total"]) for r in got.collect()} == want
