"""Event-level signals and tick-stream feature banks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, distance, ratio, wrap_degrees
from ..functions.ordered import Ordered, aggregate, exact_percentiles, group_percentile

# ---- fixed values: defaults when a player has too little input ----
DEFAULT_STEP = 2.0
DEFAULT_KEY_CV = 0.6
CLICK_WINDOW_MS = 150.0
PHYSICS_STEP_S = 1.0 / 240.0
SPECTRUM_BINS = 4096


def _turn(vx: Column, vy: Column, pvx: Column, pvy: Column) -> Column:
    n1, n2 = distance(pvx, pvy), distance(vx, vy)
    return F.when((n1 > 1e-6) & (n2 > 1e-6), F.acos(clip((vx * pvx + vy * pvy) / (n1 * n2), -1.0, 1.0)))


def key_interval_cv(events: DataFrame, slices: int = 1) -> DataFrame:
    """Coefficient of variation of press intervals per session (array order)."""
    presses = events.filter(F.col("event_type") == "key_press")
    lagged = Ordered(("session_id",), ("seq",), slices).apply(presses, lag={"_pt": "t"})
    gap = F.col("t") - F.col("_pt")
    return lagged.groupBy("session_id").agg(
        (F.stddev_pop(gap) / (F.avg(gap) + 1e-9)).alias("key_interval_cv"))


def click_reaction(events: DataFrame, slices: int = 1) -> DataFrame:
    """Every pressed click with the time since the last movement of the session."""
    moved = F.when(F.col("event_type") == "mouse_move", F.col("t"))
    seen = Ordered(("session_id",), ("t", "seq"), slices).apply(events, last={"last_move_t": moved})
    clicks = seen.filter((F.col("event_type") == "mouse_click") & F.col("pressed"))
    return clicks.select("session_id", "seq", "t", (F.col("t") - F.col("last_move_t")).alias("reaction"))


def aim_curvature(events: DataFrame, window_ms: float = CLICK_WINDOW_MS, slices: int = 1) -> DataFrame:
    """Mean turn angle of the movement in the window before each pressed click.

    A turn belongs to a click when its three points lie inside the window.  Turns are
    ordered, so the wanted ones are a difference of two running totals: those ended by
    the click minus those begun before the window.
    """
    order = Ordered(("session_id",), ("t", "seq"), slices)
    moves = events.filter(F.col("event_type") == "mouse_move").select("session_id", "t", "seq", "x", "y")
    one = order.apply(moves, lag={"x1": "x", "y1": "y", "t1": "t"})
    two = order.apply(one, lag={"x2": "x1", "y2": "y1", "t2": "t1"}).filter(F.col("t2").isNotNull())
    d = lambda a, b: (F.col(a) - F.col(b)).cast("double")
    angle = _turn(d("x", "x1"), d("y", "y1"), d("x1", "x2"), d("y1", "y2"))
    turns = two.withColumn("angle", angle)
    valid, amount = F.col("angle").isNotNull().cast("long"), F.coalesce("angle", F.lit(0.0))

    def rows(at: Column, rank: int, side: str) -> DataFrame:
        zero = F.lit(0).cast("long")
        mine = lambda s, v, z: v if s == side else z
        return turns.select(
            "session_id", at.alias("_t"), F.lit(rank).alias("_rank"), F.lit(None).cast("long").alias("seq"),
            *[mine(s, F.lit(1).cast("long"), zero).alias(f"_k_{s}") for s in ("end", "begin")],
            *[mine(s, valid, zero).alias(f"_n_{s}") for s in ("end", "begin")],
            *[mine(s, amount, F.lit(0.0)).alias(f"_a_{s}") for s in ("end", "begin")])

    clicks = events.filter((F.col("event_type") == "mouse_click") & F.col("pressed"))
    marks = [
        clicks.select("session_id", at.alias("_t"), F.lit(rank).alias("_rank"), "seq",
                      *[F.lit(0).cast("long").alias(f"_{c}_{s}") for c in "kn" for s in ("end", "begin")],
                      *[F.lit(0.0).alias(f"_a_{s}") for s in ("end", "begin")])
        for at, rank in ((F.col("t") - F.lit(float(window_ms)), 0), (F.col("t"), 2))]
    line = rows(F.col("t"), 1, "end").unionByName(rows(F.col("t2"), 1, "begin"))
    for m in marks:
        line = line.unionByName(m)
    sums = {f"s_{c}_{s}": F.col(f"_{c}_{s}") for c in "kna" for s in ("end", "begin")}
    walked = Ordered(("session_id",), ("_t", "_rank"), slices).apply(line, running=sums).filter("_rank <> 1")
    high = lambda c: F.max(F.when(F.col("_rank") == 2, F.col(f"s_{c}_end")))
    low = lambda c: F.max(F.when(F.col("_rank") == 0, F.col(f"s_{c}_begin")))
    per = walked.groupBy("session_id", "seq").agg(
        (high("k") - low("k")).alias("_k"), (high("n") - low("n")).alias("_n"), (high("a") - low("a")).alias("_a"))
    return per.filter((F.col("_k") > 0) & (F.col("_n") > 0)).select(
        "session_id", "seq", (F.col("_a") / F.col("_n")).alias("curvature"))


def session_signals(events: DataFrame, sessions: DataFrame, window_ms: float = CLICK_WINDOW_MS,
                    slices: int = 1) -> DataFrame:
    """Aim curvature before clicks, median click reaction, key-interval variation."""
    aim = aim_curvature(events, window_ms, slices).groupBy("session_id").agg(
        F.avg("curvature").alias("aim_curvature"))
    react = exact_percentiles(
        click_reaction(events, slices), ["session_id"], {"median_reaction": ("reaction", 0.5)}, slices)
    keys = key_interval_cv(events, slices)
    out = sessions.select("session_id")
    for part in (aim, react, keys):
        out = out.join(part, "session_id", "left")
    return out


def player_baseline(events: DataFrame, sessions: DataFrame, slices: int = 1) -> DataFrame:
    """Median non-zero movement step and key-interval variation per player."""
    owner = sessions.select("session_id", "player")
    step = distance(F.coalesce("dx", F.lit(0)).cast("double"), F.coalesce("dy", F.lit(0)).cast("double"))
    steps = (events.filter(F.col("event_type") == "mouse_move").withColumn("_step", step)
             .filter(F.col("_step") > 0).join(owner, "session_id"))
    scale = exact_percentiles(steps, ["player"], {"_scale": ("_step", 0.5)}, slices)
    presses = events.filter(F.col("event_type") == "key_press")
    gaps = (Ordered(("session_id",), ("seq",), slices).apply(presses, lag={"_pt": "t"})
            .withColumn("_gap", F.col("t") - F.col("_pt")).filter(F.col("_gap") > 0).join(owner, "session_id"))
    cv = gaps.groupBy("player").agg(
        F.when(F.count("_gap") >= 2, ratio(F.stddev_pop("_gap"), F.avg("_gap"))).alias("_cv"))
    return (owner.select("player").distinct().join(scale, "player", "left").join(cv, "player", "left")
            .select("player", F.coalesce("_scale", F.lit(DEFAULT_STEP)).alias("move_step_scale"),
                    F.coalesce("_cv", F.lit(DEFAULT_KEY_CV)).alias("key_interval_cv")))


def capture_kinematics(samples: DataFrame, order: str = "sample_index", slices: int = 1) -> DataFrame:
    """Per-session speed, absolute acceleration, jitter and counts of a sampled capture."""
    by = Ordered(("session_id",), (order,), slices)
    one = by.apply(samples, lag={"_px": "x", "_py": "y"})
    step = distance((F.col("x") - F.col("_px")).cast("double"), (F.col("y") - F.col("_py")).cast("double"))
    two = by.apply(one.withColumns({"_dist": step, "_speed": step / PHYSICS_STEP_S}), lag={"_pspeed": "_speed"})
    accel = F.abs(F.col("_speed") - F.col("_pspeed"))
    reach = distance(
        (F.max_by("x", order) - F.min_by("x", order)).cast("double"),
        (F.max_by("y", order) - F.min_by("y", order)).cast("double"))
    return two.groupBy("session_id").agg(
        F.avg("_speed").alias("speed_mean"), F.stddev_samp("_speed").alias("speed_std"),
        F.avg(accel).alias("accel_mean"), F.stddev_samp(accel).alias("accel_std"),
        (F.sum("_dist") / F.greatest(reach, F.lit(1e-9))).alias("jitter"),
        F.count(F.lit(1)).alias("n_ticks"), F.sum(F.col("down").cast("int")).alias("n_clicks"),
    ).filter(F.col("n_ticks") >= 3)


TICK_INPUTS = ["mdx", "mdy", "yaw", "pitch", "fire", "rclick", "fwd", "back", "left", "right",
               "accuracy_penalty", "velocity", "ping"]


def tick_window_bank(members: DataFrame, keys: Sequence[str], order: str = "seq", slices: int = 1) -> DataFrame:
    """Aim, kinematic and key features of one tick window (rows of ``TICK_INPUTS``).

    ``members`` come from ``chunk_membership``; a window holds a fixed number of ticks.
    """
    by = Ordered(tuple(keys), (order,), 1)  # a chunk has at most chunk-length rows
    lagged = by.apply(members, lag={"p_dx": "mdx", "p_dy": "mdy", "p_yaw": "yaw", "p_pitch": "pitch"})
    speed = distance(F.col("mdx"), F.col("mdy"))
    av = distance(wrap_degrees(F.col("yaw") - F.col("p_yaw")), F.col("pitch") - F.col("p_pitch"))
    step = lagged.withColumns({
        "speed": speed, "av": av,
        "turn": _turn(F.col("mdx"), F.col("mdy"), F.col("p_dx"), F.col("p_dy"))})
    step = by.apply(step, lag={"p_av": "av", "p_speed": "speed"})
    step = group_percentile(step, keys, "cut", "speed", 0.75, 1)
    w = Window.partitionBy(*keys)
    held = F.col("fwd") + F.col("back") + F.col("left") + F.col("right")
    fast = F.col("speed") > F.col("cut")
    step = step.withColumns({
        "aa": F.abs(F.col("av") - F.col("p_av")), "ds": F.abs(F.col("speed") - F.col("p_speed")),
        "limit": F.when(F.stddev_pop("av").over(w) > 0, F.avg("av").over(w) + 2 * F.stddev_pop("av").over(w)),
        "held": held, "fx": F.when(fast, F.col("mdx")), "fy": F.when(fast, F.col("mdy")),
        "fs": F.when(fast, F.col("speed"))})
    mean = lambda c: F.avg(c)
    sums = aggregate(step, keys, [
        mean("speed").alias("sp_mean"), F.stddev_pop("speed").alias("sp_std"),
        mean("ds").alias("speed_change"),
        (F.sum("speed") / F.greatest(distance(F.sum("mdx"), F.sum("mdy")), F.lit(1.0))).alias("jitter"),
        F.coalesce(mean("turn"), F.lit(0.0)).alias("curv_mean"),
        F.coalesce(F.stddev_pop("turn"), F.lit(0.0)).alias("curv_std"),
        F.coalesce(ratio(distance(F.sum("fx"), F.sum("fy")), F.sum("fs")), F.lit(0.0)).alias("fast_segment_straightness"),
        mean("av").alias("av_mean"), F.stddev_pop("av").alias("av_std"), mean("aa").alias("aa_mean"),
        F.sum(F.when(F.col("av") > F.col("limit"), 1).otherwise(0)).alias("flicks"),
        mean("fire").alias("fire_rate"), mean("rclick").alias("rclick_rate"),
        mean(F.col("held") / 4.0).alias("move_rate"),
        mean(F.when(F.col("held") > 1, 1.0).otherwise(0.0)).alias("key_overlap"),
        F.stddev_pop("yaw").alias("yaw_std"), F.stddev_pop("pitch").alias("pitch_std"),
        (F.max("yaw") - F.min("yaw")).alias("yaw_range"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"),
        mean("accuracy_penalty").alias("accpen_mean"), mean("velocity").alias("velocity_mean"), mean("ping").alias("ping"),
    ], {
        "sp_p50": ("speed", 0.5), "sp_p90": ("speed", 0.9), "sp_p99": ("speed", 0.99), "av_p99": ("av", 0.99),
        "yaw_p50": ("yaw", 0.5), "_yaw75": ("yaw", 0.75), "_yaw25": ("yaw", 0.25),
        "pit_p50": ("pitch", 0.5), "_pit75": ("pitch", 0.75), "_pit25": ("pitch", 0.25)}, 1)
    return sums.withColumns({
        "yaw_iqr": F.col("_yaw75") - F.col("_yaw25"), "pit_iqr": F.col("_pit75") - F.col("_pit25"),
    }).drop("_yaw75", "_yaw25", "_pit75", "_pit25")


TICK_BANK = [
    "sp_mean", "sp_std", "sp_p50", "sp_p90", "sp_p99", "jitter", "curv_mean", "curv_std",
    "fast_segment_straightness", "av_mean", "av_std", "av_p99", "aa_mean", "flicks",
    "fire_rate", "rclick_rate", "move_rate", "key_overlap",
    "yaw_p50", "yaw_iqr", "pit_p50", "pit_iqr", "accpen_mean", "velocity_mean", "ping",
]
IDENTITY_BANK = [
    "sp_mean", "sp_std", "speed_change", "yaw_std", "pitch_std", "yaw_range", "pitch_range",
    "fire_rate", "rclick_rate", "accpen_mean", "move_rate",
]


def press_spectrum(events: DataFrame, bins: int = SPECTRUM_BINS) -> DataFrame:
    """|rFFT| of key-press counts over ``bins`` equal time bins per session.

    Counting is a grouped aggregate, so the array handed to numpy has exactly ``bins``
    numbers however long the session is.
    """
    span = events.groupBy("session_id").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    presses = events.filter(F.col("event_type") == "key_press").join(span, "session_id")
    width = (F.col("_t1") - F.col("_t0")) / bins
    at = F.least(F.lit(bins - 1), F.floor(ratio(F.col("t") - F.col("_t0"), width)).cast("int"))
    counts = presses.filter(F.col("_t1") > F.col("_t0")).groupBy("session_id", at.alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))

    def spectrum(key, pdf: pd.DataFrame) -> pd.DataFrame:
        signal = np.zeros(bins)
        signal[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        power = np.abs(np.fft.rfft(signal))
        return pd.DataFrame({"session_id": key[0], "k": np.arange(power.size), "magnitude": power})

    return counts.groupBy("session_id").applyInPandas(spectrum, "session_id string, k long, magnitude double")
