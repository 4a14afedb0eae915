"""Watermarked counts of a replayed table: the groups of its last day are counted as well."""

import tempfile
from datetime import datetime, timedelta

import pytest

from handtrace.plans import QUERIES


@pytest.fixture(scope="module")
def table(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=5 * i), i % 2, "view", 1.0, "{}") for i in range(20)]
    rows.append((20, start + timedelta(days=9), 0, "view", 1.0, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(
        1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_every_day(spark, table):
    got = {r["start_us"] // 86_400_000_000: r["n"] for r in QUERIES["streaming_tumbling_counts"](spark, table).collect()}
    assert list(got.values()) and sum(got.values()) == 21
    assert got[max(got)] == 1 and max(got) - min(got) == 9


def test_every_session(spark, table):
    got = QUERIES["streaming_session_counts"](spark, table).collect()
    assert sorted((r["user_id"], r["n"]) for r in got) == [(0, 1), (0, 10), (1, 10)]
