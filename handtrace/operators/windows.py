"""Session-anchored windows, idle-gap segments, contiguous runs and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_LEN, IDLE_GAP_MS, MIN_SEGMENT_MS, WINDOW_MS
from ..functions.ordered import Ordered, group_extent


def anchored_windows(
    events: DataFrame,
    window_ms: float = WINDOW_MS,
    key: Sequence[str] = ("session_id",),
    slices: int = 1,
) -> DataFrame:
    """Tumbling windows counted from each session's first event.

    Adds ``window_idx``, ``w_start`` and ``w_ms`` (the observed span of the last
    window).  Empty windows leave a hole in the index; a window whose span is zero
    (one event exactly at the session end) is dropped.
    """
    spanned = group_extent(
        events, list(key), {"t_first": F.min("t"), "t_last": F.max("t")}, slices
    )
    width = F.lit(float(window_ms))
    idx = F.floor((F.col("t") - F.col("t_first")) / width)
    return (
        spanned.withColumn("window_idx", idx.cast("int"))
        .withColumn("w_start", F.col("t_first") + F.col("window_idx") * width)
        .withColumn("w_ms", F.least(width, F.col("t_last") - F.col("w_start")))
        .filter(F.col("w_ms") > 0)
        .drop("t_first", "t_last")
    )


def idle_segments(
    events: DataFrame,
    gap_ms: float = IDLE_GAP_MS,
    min_ms: float = MIN_SEGMENT_MS,
    slices: int = 1,
) -> DataFrame:
    """Number the stretches between pauses longer than ``gap_ms``; drop short ones.

    Surviving segments keep their number, so dropped ones leave a hole.
    """
    order = Ordered(("session_id",), ("t", "seq"), slices)
    gaps = order.apply(events, lag={"_pt": "t"})
    starts = F.when(F.col("t") - F.col("_pt") > gap_ms, 1).otherwise(0)
    numbered = order.apply(
        gaps.withColumn("_new", starts), running={"segment": F.col("_new")}
    )
    spanned = group_extent(
        numbered,
        ["session_id", "segment"],
        {"_from": F.min("t"), "_to": F.max("t")},
        slices,
    )
    return spanned.filter(F.col("_to") - F.col("_from") >= min_ms).drop("_pt", "_new", "_from", "_to")


def contiguous_runs(
    ticks: DataFrame,
    keys: Sequence[str],
    tie_break: Sequence[str],
    tick: str = "tick",
    max_gap: int = 2,
    min_rows: int = CHUNK_LEN,
    slices: int = 1,
) -> DataFrame:
    """Split a sampled stream where ticks are missing; keep runs of ``min_rows``.

    Duplicate ticks keep the row that is first by ``tie_break``.
    """
    first = F.min(F.struct(*tie_break, *[c for c in ticks.columns
                                         if c not in (*keys, tick, *tie_break)]))
    unique = ticks.groupBy(*keys, tick).agg(first.alias("_row")).select(*keys, tick, "_row.*")
    order = Ordered(tuple(keys), (tick,), slices)
    lagged = order.apply(unique, lag={"_pt": tick})
    numbered = order.apply(
        lagged.withColumn("_new", F.when(F.col(tick) - F.col("_pt") > max_gap, 1).otherwise(0)),
        running={"run": F.col("_new")},
    )
    sized = group_extent(
        numbered, [*keys, "run"], {"run_rows": F.count(F.lit(1))}, slices
    )
    return sized.filter(F.col("run_rows") >= min_rows).drop("_pt", "_new")


def chunk_membership(
    events: DataFrame,
    length: int = CHUNK_LEN,
    stride: int | None = None,
    key: Sequence[str] = ("session_id",),
    slices: int = 1,
) -> DataFrame:
    """Assign rows (dense 0-based ``seq``) to fixed-length chunks.

    Chunk ``c`` covers ``seq`` in [c*stride, c*stride + length); only full chunks
    exist.  An overlapping stride repeats a row once per chunk it falls into, so the
    fan-out is at most ceil(length / stride).
    """
    stride = stride or length
    sized = group_extent(events, list(key), {"_n": F.count(F.lit(1))}, slices)
    last_start = F.floor((F.col("_n") - length) / stride)
    newest = F.least(F.floor(F.col("seq") / stride), last_start)
    oldest = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("seq") - length + 1) / stride))
    usable = sized.filter((F.col("_n") >= length) & (newest >= oldest))
    if stride == length:
        placed = usable.withColumn("chunk_idx", newest.cast("long"))
    else:
        placed = usable.withColumn(
            "chunk_idx", F.explode(F.sequence(oldest.cast("long"), newest.cast("long")))
        )
    return placed.withColumn("start_seq", F.col("chunk_idx") * stride).drop("_n")
