"""Game-outcome telemetry: combat windows, view-angle speed and clock alignment.

Works on many sessions and all their players at once.  Tables: kills (session_id,
tick, attacker_name, user_name, headshot), hurts (session_id, tick, attacker_name,
dmg_health, hitgroup), fires (session_id, tick, user_name), angles (session_id, name,
tick, pitch, yaw).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FLICK_DEG_PER_S, OUTCOME_FEATURES, SYNC_STRONG_PEAK, WINDOW_MS
from ..functions.exprs import distance, ratio, wrap_degrees
from ..functions.ordered import Ordered, aggregate
from .joins import attach_outcome, lagged_products
from .stats import resample

COUNTS = ["kills", "deaths", "headshot_kills", "hits_dealt", "damage_dealt", "head_hits", "shots_fired"]


@dataclass(frozen=True)
class Outcomes:
    kills: DataFrame
    hurts: DataFrame
    fires: DataFrame
    angles: DataFrame
    tick_rate: float


def tick_seconds(tick: Column, tick_rate: float) -> Column:
    return tick / F.lit(float(tick_rate))


def view_speed(angles: DataFrame, tick_rate: float, slices: int = 1) -> DataFrame:
    """(session_id, player, time_s, angvel): degrees per second at the later tick.

    Yaw differences wrap, pitch differences do not; repeated ticks yield no row.
    """
    named = angles.withColumnRenamed("name", "player")
    lagged = Ordered(("session_id", "player"), ("tick", "yaw", "pitch"), slices).apply(
        named, lag={"_tick": "tick", "_yaw": "yaw", "_pitch": "pitch"})
    dt = (F.col("tick") - F.col("_tick")) / F.lit(float(tick_rate))
    turn = distance(wrap_degrees(F.col("yaw") - F.col("_yaw")), F.col("pitch") - F.col("_pitch"))
    return lagged.filter(dt > 0).select(
        "session_id", "player", tick_seconds(F.col("tick"), tick_rate).alias("time_s"), (turn / dt).alias("angvel"))


def outcome_windows(
    out: Outcomes, window_ms: float = WINDOW_MS, offsets: DataFrame | None = None, slices: int = 1
) -> DataFrame:
    """13 outcome features per (session, player, window).

    The four sources are tagged and stacked, so one grouping yields the union of their
    windows.  ``offsets`` (session_id, offset_s) is the demo time of recorder zero;
    windows before it have negative numbers.
    """
    zero, one = F.lit(0).cast("double"), F.lit(1).cast("double")

    def tagged(df: DataFrame, player: str, seconds: Column, **values: Column) -> DataFrame:
        cols = [F.coalesce(values.get(c, zero).cast("double"), zero).alias(c) for c in COUNTS]
        return df.filter(F.col(player).isNotNull()).select(
            "session_id", F.col(player).alias("player"), seconds.alias("_s"), *cols,
            values.get("angvel", F.lit(None)).cast("double").alias("angvel"))

    at = tick_seconds(F.col("tick"), out.tick_rate)
    head = F.when(F.col("headshot"), 1).otherwise(0)
    rows = (
        tagged(out.kills, "attacker_name", at, kills=one, headshot_kills=head)
        .unionByName(tagged(out.kills, "user_name", at, deaths=one))
        .unionByName(tagged(out.hurts, "attacker_name", at, hits_dealt=one, damage_dealt=F.col("dmg_health"),
                            head_hits=F.when(F.col("hitgroup") == "head", 1).otherwise(0)))
        .unionByName(tagged(out.fires, "user_name", at, shots_fired=one))
        .unionByName(tagged(view_speed(out.angles, out.tick_rate, slices), "player", F.col("time_s"),
                            angvel=F.col("angvel"))))
    if offsets is not None:
        rows = rows.join(offsets.select("session_id", "offset_s"), "session_id", "left")
        rows = rows.withColumn("_s", F.col("_s") - F.coalesce("offset_s", F.lit(0.0)))
    rows = rows.withColumn("window_idx", F.floor(F.col("_s") / F.lit(window_ms / 1000.0)).cast("int"))
    sums = aggregate(
        rows, ["session_id", "player", "window_idx"],
        [*[F.sum(c).alias(c) for c in COUNTS],
         F.max("angvel").alias("view_angvel_max"),
         F.sum(F.when(F.col("angvel") > FLICK_DEG_PER_S, 1).otherwise(0)).cast("double").alias("flick_count")],
        {"view_angvel_p50": ("angvel", 0.5), "view_angvel_p99": ("angvel", 0.99)}, slices)
    part = lambda num, den: F.coalesce(ratio(F.col(num), F.col(den)), zero)
    shaped = sums.withColumns({
        "accuracy": part("hits_dealt", "shots_fired"),
        "damage_per_shot": part("damage_dealt", "shots_fired"),
        "kills_per_shot": part("kills", "shots_fired"),
        "headshot_ratio": F.when(F.col("hits_dealt") > 0, part("head_hits", "hits_dealt"))
        .otherwise(part("headshot_kills", "kills")),
        **{c: F.coalesce(F.col(c), zero) for c in ("view_angvel_p50", "view_angvel_p99", "view_angvel_max")}})
    return shaped.select("session_id", "player", "window_idx", *OUTCOME_FEATURES)


def most_active(fires: DataFrame) -> DataFrame:
    """Player with the most shots per session (ties: first name)."""
    shots = fires.groupBy("session_id", F.col("user_name").alias("player")).agg(F.count(F.lit(1)).alias("shots"))
    return shots.groupBy("session_id").agg(
        F.min_by("player", F.struct(-F.col("shots"), F.col("player"))).alias("player"), F.max("shots").alias("shots"))


def recorder_speed(events: DataFrame, slices: int = 1) -> DataFrame:
    """(session_id, s, v): pointer speed in px/s, seconds since the first moving sample."""
    moves = events.filter(F.col("event_type") == "mouse_move")
    lagged = Ordered(("session_id",), ("seq",), slices).apply(moves, lag={"_pt": "t"})
    dt = (F.col("t") - F.col("_pt")) / 1000.0
    step = distance(F.coalesce("dx", F.lit(0)).cast("double"), F.coalesce("dy", F.lit(0)).cast("double"))
    kept = lagged.filter(dt > 0).select("session_id", "t", (step / dt).alias("v"))
    first = kept.groupBy("session_id").agg(F.min("t").alias("_t0"))
    return kept.join(first, "session_id").select("session_id", ((F.col("t") - F.col("_t0")) / 1000.0).alias("s"), "v")


def clock_offsets(demo: DataFrame, recorder: DataFrame, hz: float, max_lag_s: float = 30.0, slices: int = 1) -> DataFrame:
    """(session_id, offset_s, peak_corr, lag): demo time of the recorder's first movement.

    Both inputs are (session_id, s, v); each is put on a grid of ``hz`` and the lag of
    the highest normalised correlation wins (the lowest lag on ties).
    """
    keys = ["session_id"]
    a, b = resample(demo, keys, hz), resample(recorder, keys, hz)
    lag = int(round(max_lag_s * hz))
    corr = lagged_products(a, b, keys, lag, slices)
    best = corr.groupBy(*keys).agg(F.min_by(F.struct("lag", "corr"), F.struct(-F.col("corr"), F.col("lag"))).alias("_b"))
    start = demo.groupBy(*keys).agg(F.min("s").alias("_s0"))
    sessions = demo.select(*keys).unionByName(recorder.select(*keys)).distinct()
    joined = sessions.join(start, keys, "left").join(best, keys, "left")
    offset = F.when(F.col("_b").isNull(), 0.0).otherwise(F.col("_s0") + F.col("_b.lag") / F.lit(float(hz)))
    return joined.select(
        *keys, offset.alias("offset_s"), F.coalesce("_b.corr", F.lit(0.0)).alias("peak_corr"),
        F.coalesce("_b.lag", F.lit(0)).alias("lag"))


def anchor_offsets(offsets: DataFrame, events: DataFrame) -> DataFrame:
    """Move the offset from the first movement back to the session's first event."""
    gaps = events.groupBy("session_id").agg(
        ((F.min(F.when(F.col("event_type") == "mouse_move", F.col("t"))) - F.min("t")) / 1000.0).alias("_gap"))
    return offsets.join(gaps, "session_id", "left").withColumn(
        "offset_s", F.col("offset_s") - F.coalesce("_gap", F.lit(0.0))).drop("_gap")


def sync_verdict(offsets: DataFrame, inputs: DataFrame, joined: DataFrame) -> DataFrame:
    """STRONG or WEAK per session with input, matched window counts."""
    n = inputs.groupBy("session_id").agg(F.count(F.lit(1)).alias("input_windows"))
    m = joined.groupBy("session_id").agg(F.sum(F.col("has_outcome").cast("int")).alias("matched_windows"))
    verdict = F.when(F.col("peak_corr") >= SYNC_STRONG_PEAK, "STRONG").otherwise("WEAK")
    return offsets.join(n, "session_id", "left").join(m, "session_id", "left").select(
        "session_id", "offset_s", "peak_corr", verdict.alias("verdict"),
        F.coalesce("input_windows", F.lit(0)).alias("input_windows"),
        F.coalesce("matched_windows", F.lit(0)).alias("matched_windows"))


def aligned_table(inputs: DataFrame, out: Outcomes, owners: DataFrame, offsets: DataFrame | None = None,
                  window_ms: float = WINDOW_MS, slices: int = 1) -> DataFrame:
    """Input windows joined with their owner's outcome windows.

    ``owners`` (session_id, player) says whose telemetry a session holds.
    """
    windows = outcome_windows(out, window_ms, offsets, slices)
    mine = windows.join(owners.select("session_id", "player"), ["session_id", "player"], "left_semi")
    return attach_outcome(inputs, mine, OUTCOME_FEATURES)


def session_totals(windows: DataFrame) -> DataFrame:
    """Totals per (session, player); headshot ratio weighted by hits (at least 1)."""
    weight = F.greatest(F.col("hits_dealt"), F.lit(1.0))
    return windows.groupBy("session_id", "player").agg(
        *[F.sum(c).alias(c) for c in ("kills", "deaths", "shots_fired", "hits_dealt", "damage_dealt", "flick_count")],
        (F.sum(F.col("headshot_ratio") * weight) / F.sum(weight)).alias("headshot_ratio"),
        F.max("view_angvel_max").alias("view_angvel_max"))


def player_rollup(ticks: DataFrame, slices: int = 1) -> DataFrame:
    """Per (player, label): highest kill and damage counters, active shots, median ping."""
    return aggregate(ticks, ["player", "label"], [
        F.max("kills").alias("kills"), F.max("damage").alias("damage"),
        F.sum((F.col("fire") > 0).cast("int")).alias("active_shots")], {"ping": ("ping", 0.5)}, slices)
