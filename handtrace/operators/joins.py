"""Join shapes the telemetry work needs beyond plain equality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered, group_extent, join_keys
from ..session import ship_package


def asof_forward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_value: str,
    on: str = "t", out: str = "matched", slices: int = 1,
) -> DataFrame:
    """Nearest right row at or after each left row, by key.

    Union and a reversed ordered pass: one shuffle on the key, no range comparison.
    """
    return _asof(left, right, keys, right_value, on, out, slices, forward=True)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_value: str,
    on: str = "t", out: str = "matched", slices: int = 1,
) -> DataFrame:
    """Latest right row at or before each left row, by key."""
    return _asof(left, right, keys, right_value, on, out, slices, forward=False)


def _asof(left, right, keys, right_value, on, out, slices, forward):
    # On equal times the right row must come first in walking order.
    right_rank = 1 if forward else 0
    ident = [c for c in left.columns if c not in (*keys, on)]
    a = left.withColumns({"_rank": F.lit(1 - right_rank), "_value": F.lit(None)})
    b = right.select(
        *keys, F.col(on), F.col(right_value).alias("_value"), F.lit(right_rank).alias("_rank"))
    both = a.withColumn("_value", F.col("_value").cast(b.schema["_value"].dataType)).unionByName(
        b, allowMissingColumns=True)
    walked = Ordered(tuple(keys), (on, "_rank", *ident), slices, reverse=forward).apply(
        both, last={out: F.col("_value")})
    return walked.filter(F.col("_rank") == 1 - right_rank).select(*left.columns, out)


def last_before(
    events: DataFrame, keys: Sequence[str], value: Column, out: str, slices: int = 1
) -> DataFrame:
    """Latest non-NULL ``value`` strictly earlier in (t, seq) order."""
    return Ordered(tuple(keys), ("t", "seq"), slices).apply(events, last={out: value})


def range_aggregate(
    anchors: DataFrame, points: DataFrame, before_ms: float, value: str | None = None,
    anchor_id: Sequence[str] = ("seq",), key: str = "session_id", slices: int = 1,
) -> DataFrame:
    """Count (and sum) of points in [anchor_t - before_ms, anchor_t] per anchor.

    A range join without pairs: each anchor puts one marker at either end of its range
    among the points, and the answer is the difference of two running totals.  Cost is
    linear however many points share a range.
    """
    ids = list(anchor_id)
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    p = points.select(key, F.col("t").alias("_t"), F.lit(1).alias("_rank"),
                      F.lit(1).alias("_one"), amount.alias("_amount"))
    marker = lambda at, rank: anchors.select(
        key, at.alias("_t"), F.lit(rank).alias("_rank"), *ids)
    low = marker(F.col("anchor_t") - F.lit(float(before_ms)), 0)
    high = marker(F.col("anchor_t"), 2)
    both = p.unionByName(low, allowMissingColumns=True).unionByName(high, allowMissingColumns=True)
    return _range_totals(
        both.withColumns({"_one": F.coalesce("_one", F.lit(0)), "_amount": F.coalesce("_amount", F.lit(0.0))}), ids, key, slices)


def range_aggregate_within(
    events: DataFrame, is_anchor: Column, is_point: Column, before_ms: float, value: str | None = None,
    anchor_id: Sequence[str] = ("seq",), key: str = "session_id", slices: int = 1,
) -> DataFrame:
    """``range_aggregate`` where anchors and points are rows of one table, which is read and ordered once."""
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    row = lambda at, rank, one, sum_: F.struct(
        at.alias("_t"), F.lit(rank).alias("_rank"), F.lit(one).alias("_one"), F.coalesce(sum_, F.lit(0.0)).alias("_amount"))
    rows = F.array(
        F.when(is_point, row(F.col("t"), 1, 1, amount)),
        F.when(is_anchor, row(F.col("t") - F.lit(float(before_ms)), 0, 0, F.lit(0.0))),
        F.when(is_anchor, row(F.col("t"), 2, 0, F.lit(0.0))))
    both = events.select(key, *anchor_id, F.inline(F.filter(rows, lambda r: r.isNotNull())))
    return _range_totals(both, list(anchor_id), key, slices)


def _range_totals(both: DataFrame, ids: list[str], key: str, slices: int) -> DataFrame:
    """Differences of the running totals between the two markers of every anchor."""
    summed = Ordered((key,), ("_t", "_rank"), slices).apply(both, running={"_n": F.col("_one"), "_s": F.col("_amount")})
    ends = summed.filter(F.col("_rank") != 1)
    at = lambda c, rank: F.max(F.when(F.col("_rank") == rank, F.col(c)))
    return ends.groupBy(key, *ids).agg(
        (at("_n", 2) - at("_n", 0)).alias("points"),
        (at("_s", 2) - at("_s", 0)).alias("total"))


def merge_spans(spans: DataFrame, slices: int = 1) -> DataFrame:
    """Union of overlapping or touching spans per (session, cheat)."""
    keys = ("session_id", "cheat")
    reach = Ordered(keys, ("start_ms", "end_ms"), slices).apply(
        spans, highest={"_reach": F.col("end_ms")})
    fresh = F.when(F.col("_reach") >= F.col("start_ms"), 0).otherwise(1)
    numbered = Ordered(keys, ("start_ms", "end_ms"), slices).apply(
        reach.withColumn("_new", fresh), running={"_island": F.col("_new")})
    return numbered.groupBy(*keys, "_island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def interval_join(events: DataFrame, spans: DataFrame, slices: int = 1) -> DataFrame:
    """Events inside the spans of their session, both ends included: one row per
    (event, cheat).

    Spans of one cheat are merged first, so the only candidate for an event is the
    latest span starting at or before it: an as-of step instead of a range product.
    Events are repeated once per cheat name of their session, a handful of names.
    """
    merged = merge_spans(spans, slices)
    names = merged.select("session_id", "cheat").distinct()
    spread = events.join(names, "session_id")
    found = asof_backward(
        spread, merged.select("session_id", "cheat", F.col("start_ms").alias("t"), "end_ms"),
        ["session_id", "cheat"], "end_ms", out="_end", slices=slices)
    return found.filter(F.col("_end") >= F.col("t")).drop("_end")


def attach_outcome(inputs: DataFrame, outcome: DataFrame, values: Sequence[str]) -> DataFrame:
    """Input windows with their outcome row, ``has_outcome`` and zeros where absent."""
    marked = outcome.select("session_id", "window_idx", *values, F.lit(True).alias("_found"))
    joined = inputs.join(marked, ["session_id", "window_idx"], "left")
    return joined.withColumns({
        "has_outcome": F.coalesce("_found", F.lit(False)),
        **{v: F.coalesce(F.col(v), F.lit(0)) for v in values},
    }).drop("_found")


def lagged_products(
    a: DataFrame, b: DataFrame, keys: Sequence[str], max_lag: int, slices: int = 1
) -> DataFrame:
    """Normalised cross-correlation of two gridded series (``i``, ``v``) per key.

    Both series are cut into blocks of about ``max_lag`` places; a block of ``b`` meets the few blocks of
    ``a`` within the lag, and each pair gives one vector of products by lag, added up inside its task.
    ``a.i = b.i + lag``; series without variance and lags without common places yield no rows.
    """
    size = min(max(max_lag, 64), 4096)
    block = F.floor(F.col("i") / size).cast("int")
    sides = [
        _unit(df, keys, slices).groupBy(*keys, block.alias(f"_{name}")).agg(F.array_sort(F.collect_list(  # ``size`` at most
            F.struct((F.col("i") - F.floor(F.col("i") / size) * size).cast("int").alias("at"), "u"))).alias(f"_{name}s"))
        for name, df in (("a", a), ("b", b))]
    first = F.floor((F.col("_b") * size - max_lag) / size).cast("int")
    last = F.floor((F.col("_b") * size + size - 1 + max_lag) / size).cast("int")
    pairs = join_keys(sides[1].withColumn("_a", F.explode(F.sequence(first, last))), sides[0], [*keys, "_a"])
    pairs = pairs.select(*keys, ((F.col("_a") - F.col("_b")) * size).alias("_shift"), "_as", "_bs")
    names = list(keys)

    def dense(block_rows) -> tuple[np.ndarray, np.ndarray]:
        values, there = np.zeros(size), np.zeros(size)
        at = [r["at"] for r in block_rows]
        values[at], there[at] = [r["u"] for r in block_rows], 1.0
        return values, there

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(names, dropna=False, sort=False):
                total, seen = np.zeros(2 * max_lag + 1), np.zeros(2 * max_lag + 1, bool)
                for shift, left, right in zip(rows["_shift"], rows["_as"], rows["_bs"]):
                    (x, in_x), (y, in_y) = dense(left), dense(right)
                    lag = np.arange(1 - size, size) + shift
                    inside = np.abs(lag) <= max_lag
                    total[lag[inside] + max_lag] += np.correlate(x, y, "full")[inside]
                    seen[lag[inside] + max_lag] |= np.correlate(in_x, in_y, "full")[inside] > 0.5
                out = pd.DataFrame({"lag": np.flatnonzero(seen) - max_lag, "corr": total[seen]})
                for name, value in zip(names, key):
                    out[name] = None if pd.isna(value) else value
                yield out[[*names, "lag", "corr"]]

    ship_package(pairs.sparkSession)
    types = dict(pairs.dtypes)
    found = pairs.mapInPandas(products, ", ".join([*[f"`{k}` {types[k]}" for k in names], "lag int, corr double"]))
    return found.groupBy(*keys, "lag").agg(F.sum("corr").alias("corr"))


def _unit(series: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    stats = {"_mean": F.avg("v"), "_n": F.count(F.lit(1))}
    centred = group_extent(series, keys, stats, slices).withColumn("c", F.col("v") - F.col("_mean"))
    scaled = group_extent(centred, keys, {"_ss": F.sum(F.col("c") * F.col("c"))}, slices)
    return scaled.filter((F.col("_n") >= 2) & (F.col("_ss") > 0)).withColumn(
        "u", F.col("c") / F.sqrt("_ss")).drop("_mean", "_n", "_ss", "c")


def keep_known(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on).distinct(), on, "left_semi")


def keep_unknown(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on).distinct(), on, "left_anti")
