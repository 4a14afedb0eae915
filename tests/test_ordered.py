"""The path for oversized groups must give the rows of the plain window."""

import math
import random

import pytest
from pyspark.sql import functions as F

from handtrace.functions import ordered as o
from handtrace.operators import splits
from handtrace.operators import stats as st


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(60)), i, rng.choice([None, 1.0, 2.0, 5.0])) for i in range(400)]
    rows += [(None, float(rng.randrange(30)) if i % 7 else None, 2000 + i, float(i % 5)) for i in range(300)]
    rows += [(f"k{i % 9}", float(rng.randrange(20)), 1000 + i, float(i % 4)) for i in range(60)]
    return spark.createDataFrame(rows, "g string, t double, seq long, v double").cache()


@pytest.mark.parametrize("reverse", [False, True])
def test_sliced_equals_plain(skewed, reverse):
    def run(slices):
        df = o.Ordered(("g",), ("t", "seq"), slices, reverse).apply(
            skewed, lag={"p": "v"}, last={"l": F.col("v")}, running={"s": F.col("v")},
            position="n", highest={"h": F.col("v")})
        return sorted(df.collect(), key=lambda r: (r["g"] or "", r["seq"]))
    assert run(1) == run(6)


def test_chained_steps_keep_user_columns(skewed):
    def run(slices):
        by = o.Ordered(("g",), ("t", "seq"), slices)
        one = by.apply(skewed, position="_at")
        two = by.apply(one, lag={"q": "_at"})
        return sorted(map(tuple, two.select("seq", "_at", "q").fillna(-1).collect()))
    assert run(1) == run(5)


def test_exact_percentiles(skewed):
    def run(slices):
        df = o.aggregate(skewed, ["g"], [F.count("v").alias("n")],
                         {"a": ("v", 0.25), "b": ("v", 0.9), "c": ("t", 0.5)}, slices)
        return sorted((r["g"] or "", r["n"], round(r["a"], 9), round(r["b"], 9), round(r["c"], 9)) for r in df.collect())
    assert run(1) == run(4)


def test_slices_are_balanced(skewed):
    tagged = o.with_slices(skewed, ["g"], "t", 8)
    sizes = tagged.filter("g = 'hot'").groupBy("_slice").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 120
    assert tagged.filter("g <> 'hot'").select("_slice").distinct().count() == 1


def test_slice_count_follows_group_size(skewed, monkeypatch):
    assert o.measure_slices(skewed, ["g"]) == 1
    monkeypatch.setattr(o, "ROWS_PER_SLICE", 100)
    assert o.measure_slices(skewed, ["g"]) == 4


def test_group_columns_reach_null_keys(skewed):
    def run(slices):
        df = o.group_extent(skewed, ["g"], {"n": F.count("v"), "last": F.max("t")}, slices)
        df = o.group_percentile(df, ["g"], "p", "t", 0.4, slices)
        return sorted((r["seq"], r["n"], r["last"], round(r["p"], 9)) for r in df.collect())
    assert run(1) == run(5)
    assert all(None not in row for row in run(5))


def test_splits_are_equal_when_a_group_is_cut(spark):
    rows = [(p, f"session_{i:06d}" + ("\u012c" if i % 3 else ""), False) for i, p in enumerate([None, "b"] * 60)]
    rows += [("c", x, None) for x in ("aa", "a\u012c", "b", "bb", "c")]
    table = spark.createDataFrame(rows, "player string, session_id string, is_cheat_session boolean")

    def run(split):
        return sorted(map(str, split.collect()))
    for make in (
        lambda n: splits.stratified_sessions(table, 0.2, 0.2, 2, slices=n),
        lambda n: splits.stratified_half(table, "player", "session_id", slices=n),
        lambda n: splits.last_share(table, "player", 0.6, slices=n).select("player", "session_id", "part"),
    ):
        assert run(make(1)) == run(make(5))
    held = splits.last_share(table.where("player = 'c'"), "player", 0.6, slices=4).where("part = 'test'")
    assert {r["session_id"] for r in held.collect()} == {"b", "bb", "c"}


def test_tails_have_their_known_values(spark):
    row = spark.range(1).select(
        st.normal_tail(F.lit(1.0)), st.normal_tail(F.lit(1.959963984540054)), st.normal_tail(F.lit(6.0)),
        st.normal_tail(F.lit(0.0)), *[st.chi2_tail(F.lit(x), F.lit(k)) for x, k in ((6.0, 2), (15.0, 2), (3.841458820694124, 1), (7.8147279032511765, 3), (9.487729036781154, 4))]).first()
    want = [0.31731050786291415, 0.05, 1.9731752900753e-09, 1.0, math.exp(-3), math.exp(-7.5), 0.05, 0.05, 0.05]
    assert all(abs(got / w - 1) < 1e-10 for got, w in zip(row, want))
