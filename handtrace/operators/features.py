"""The 30-feature window bank.

All features of a window come from one grouping over rows that already carry their
neighbours.  The expensive columns are computed on partitions that refine the
session, so a session-partitioned input is shuffled once for the whole bank.  Device
normalisation is linear, so it is applied to the aggregated rows, where the session
table joins at window grain instead of event grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ACTIVE_BUCKET_MS, FEATURES, MOVEMENT_KEYS, REFERENCE_DPI, REFERENCE_POLLING_HZ, WINDOW_MS,
)
from ..functions.exprs import clip, distance, ratio
from ..functions.ordered import Ordered, aggregate, group_percentile
from .windows import anchored_windows

GRAIN = ("session_id", "window_idx")


def norm_factor(sensitivity: Column, dpi: Column) -> Column:
    return sensitivity.cast("double") * dpi.cast("double") / F.lit(REFERENCE_DPI)


def rate_norm(polling_rate: Column) -> Column:
    """Scale to the reference polling rate; 1 when missing, unparsable or not positive."""
    hz = F.expr("1") if polling_rate is None else polling_rate
    hz = hz.cast("string").try_cast("double")
    return F.when(hz > 0, F.lit(REFERENCE_POLLING_HZ) / hz).otherwise(F.lit(1.0))


def _with_neighbours(ev: DataFrame, keys: tuple[str, ...], slices: int) -> DataFrame:
    kind = F.col("event_type")
    pressed = F.coalesce(F.col("pressed"), F.lit(False))
    role = (
        F.when(kind == "mouse_move", "move")
        .when((kind == "mouse_click") & pressed, "click")
        .when(kind == "key_press", "press")
        .otherwise("other")
    )
    movement = (kind == "key_press") & F.lower("key").isin(MOVEMENT_KEYS)
    ev = ev.withColumn("role", role).withColumn("movement_t", F.when(movement, F.col("t")))

    by_role = Ordered((*keys, "role"), ("t", "seq"), slices)
    ev = by_role.apply(
        ev,
        lag={"p_t": "t", "p_x": "x", "p_y": "y"},
        last={"p_movement_t": F.col("movement_t")},
    )
    is_move = F.col("role") == "move"
    gap = F.nullif(F.col("t") - F.col("p_t"), F.lit(0.0))
    ev = ev.withColumns({
        "gap": gap,
        "dist": F.when(is_move, distance(F.col("dx").cast("double"), F.col("dy").cast("double"))),
        "vx": F.when(is_move, (F.col("x") - F.col("p_x")).cast("double")),
        "vy": F.when(is_move, (F.col("y") - F.col("p_y")).cast("double")),
    }).withColumns({
        "norm": distance(F.col("vx"), F.col("vy")),
        "raw_speed": F.when(F.col("p_t").isNotNull(), F.col("dist") / F.col("gap")),
    })
    ev = by_role.apply(ev, lag={"p_vx": "vx", "p_vy": "vy", "p_norm": "norm", "p_speed": "raw_speed"})

    is_key = kind.isin("key_press", "key_release")
    ev = ev.withColumns({
        "active_bucket_t": F.col("t"),
        "move_t": F.when(is_move, F.col("t")),
        "hold_key": F.when(is_key, F.col("key")),
        "release_first": F.when(kind == "key_release", 1).otherwise(0),
        "release_t": F.when(kind == "key_release", F.col("t")),
    })
    ev = Ordered(keys, ("t", "seq"), slices).apply(
        ev, lag={"p_any_t": "t"}, last={"last_move_t": F.col("move_t")}
    )
    return Ordered((*keys, "hold_key"), ("t", "release_first", "seq"), slices, reverse=True).apply(
        ev, last={"next_release_t": F.col("release_t")}
    )


def raw_window_features(
    windowed: DataFrame,
    keys: tuple[str, ...] = GRAIN,
    bucket_ms: float = ACTIVE_BUCKET_MS,
    slices: int = 1,
) -> DataFrame:
    """Features per window before device normalisation.

    ``windowed`` holds ``w_start`` and ``w_ms`` (see ``anchored_windows``).
    """
    ev = _with_neighbours(windowed, keys, slices)
    ev = group_percentile(ev, list(keys), "fast_cut", "norm", 0.75, slices)

    move, click, press = (F.col("role") == r for r in ("move", "click", "press"))
    turn_ok = (F.col("norm") > 1e-6) & (F.col("p_norm") > 1e-6)
    cos = (F.col("vx") * F.col("p_vx") + F.col("vy") * F.col("p_vy")) / (
        F.col("norm") * F.col("p_norm") + 1e-12
    )
    flip = sum(
        F.when(F.signum(v) * F.signum(p) < 0, 1).otherwise(0)
        for v, p in ((F.col("vx"), F.col("p_vx")), (F.col("vy"), F.col("p_vy")))
    )
    since = F.col("t") - F.col("p_t")
    hold = F.col("next_release_t") - F.col("t")
    bucket = F.least(
        F.floor((F.col("t") - F.col("w_start")) / bucket_ms),
        F.greatest(F.lit(1), F.bround(F.col("w_ms") / bucket_ms).cast("long")) - 1,
    )
    previous_bucket = F.least(
        F.floor((F.col("p_any_t") - F.col("w_start")) / bucket_ms),
        F.greatest(F.lit(1), F.bround(F.col("w_ms") / bucket_ms).cast("long")) - 1,
    )
    fast = F.col("norm") > F.col("fast_cut")
    ev = ev.withColumns({
        "accel": F.when(move, (F.col("raw_speed") - F.col("p_speed")) / F.col("gap")),
        "angle": F.when(turn_ok, F.acos(clip(cos, -1.0, 1.0))),
        "flips": flip,
        "click_gap": F.when(click, since),
        "press_gap": F.when(press, since),
        "movement_gap": F.col("movement_t") - F.col("p_movement_t"),
        "hold": F.when(press & (hold > 0), hold),
        "reaction": F.when(click, F.col("t") - F.col("last_move_t")),
        "click_step": F.when(click, distance(
            (F.col("x") - F.col("p_x")).cast("double"), (F.col("y") - F.col("p_y")).cast("double"))),
        "new_bucket": F.when(F.col("p_any_t").isNull() | (bucket != previous_bucket), 1).otherwise(0),
        "fast_vx": F.when(fast, F.col("vx")),
        "fast_vy": F.when(fast, F.col("vy")),
        "fast_norm": F.when(fast, F.col("norm")),
    })

    at = F.struct("t", "seq")
    kind = F.col("event_type")
    n_if = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    ends = {
        f"{c}_{side}": pick(F.when(move, F.col(c)), F.when(move, at))
        for c in ("x", "y") for side, pick in (("first", F.min_by), ("last", F.max_by))
    }
    sums = aggregate(
        ev,
        list(keys),
        [
            F.first("w_ms").alias("w_ms"),
            F.count(F.lit(1)).alias("n"),
            n_if(move).alias("n_move"), n_if(press).alias("n_press"),
            n_if(kind.startswith("mouse")).alias("n_mouse"),
            n_if(kind.isin("key_press", "key_release")).alias("n_key"),
            n_if(kind == "mouse_scroll").alias("scroll_count"),
            n_if((kind == "mouse_scroll") & (F.col("dy") > 0)).alias("n_down"),
            *[e.alias(name) for name, e in ends.items()],
            F.sum("dist").alias("dist"), F.sum("norm").alias("path"),
            F.sum("fast_vx").alias("fast_vx"), F.sum("fast_vy").alias("fast_vy"),
            F.sum("fast_norm").alias("fast_norm"),
            F.sum("flips").alias("flips"), F.sum("new_bucket").alias("active"),
            F.avg("raw_speed").alias("speed_mean"), F.stddev_samp("raw_speed").alias("speed_std"),
            F.avg("accel").alias("accel_mean"), F.stddev_samp("accel").alias("accel_std"),
            F.avg("click_gap").alias("click_interval_mean"),
            F.stddev_samp("click_gap").alias("click_interval_std"),
            F.avg("angle").alias("mouse_curvature_mean"),
            F.stddev_pop("angle").alias("mouse_curvature_std"),
            F.avg("press_gap").alias("iki_mean"), F.stddev_samp("press_gap").alias("iki_std"),
            F.stddev_pop("press_gap").alias("iki_pop"),
            F.avg("hold").alias("hold_mean"), F.stddev_samp("hold").alias("hold_std"),
            F.var_samp("movement_gap").alias("wasd_rhythm"),
            F.avg("reaction").alias("click_reaction_mean"),
            F.avg("click_step").alias("inter_click_movement"),
        ],
        {
            "speed_p50": ("raw_speed", 0.5), "speed_p90": ("raw_speed", 0.9),
            "speed_p99": ("raw_speed", 0.99), "click_reaction_p5": ("reaction", 0.05),
        },
        slices,
    )

    seconds = F.col("w_ms") / 1000.0
    reach = distance(
        (F.col("x_last") - F.col("x_first")).cast("double"),
        (F.col("y_last") - F.col("y_first")).cast("double"),
    )
    moves3 = F.col("n_move") >= 3
    shaped = {
        "jitter": F.when(F.col("n_move") >= 2, F.col("dist") / F.greatest(reach, F.lit(1.0))),
        "path_efficiency": F.when(moves3 & (F.col("path") > 1e-6), ratio(reach, F.col("path"))),
        "fast_segment_straightness": F.when(
            (F.col("n_move") >= 5) & (F.col("fast_norm") > 1e-6),
            ratio(distance(F.col("fast_vx"), F.col("fast_vy")), F.col("fast_norm"))),
        "mouse_curvature_mean": F.when(moves3, F.col("mouse_curvature_mean")),
        "mouse_curvature_std": F.when(moves3, F.col("mouse_curvature_std")),
        "direction_changes_per_sec": F.when(moves3, F.col("flips") / seconds),
        "burst_rate": F.col("n_press") / seconds,
        "keystroke_periodicity": F.when(
            (F.col("n_press") >= 3) & (F.col("iki_mean") > 1e-6),
            ratio(F.col("iki_pop"), F.col("iki_mean"))),
        "event_rate": F.col("n") / seconds,
        "mouse_key_ratio": F.col("n_mouse") / (F.col("n_key") + 1e-9),
        "active_time_pct": F.col("active") / F.greatest(
            F.lit(1), F.bround(F.col("w_ms") / bucket_ms).cast("long")),
        "scroll_direction_ratio": ratio(
            F.col("n_down").cast("double"), F.col("scroll_count").cast("double")),
    }
    return sums.withColumns(shaped).select(*keys, "w_ms", "n", *FEATURES)


SPEED_SCALED = ["speed_mean", "speed_std", "speed_p50", "speed_p90", "speed_p99",
                "accel_mean", "accel_std"]
RATE_SCALED = ["direction_changes_per_sec", "event_rate", "mouse_key_ratio"]


def normalise_devices(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Join session metadata at window grain and apply both device factors."""
    nf = norm_factor(F.col("sensitivity"), F.col("dpi"))
    rn = rate_norm(F.col("polling_rate"))
    meta = sessions.select(
        "session_id", "player", "game", "activity", "is_cheat_session", "sensitivity",
        "dpi", "polling_rate", "recorded_at", "duration_ms",
    )
    joined = raw.join(meta, "session_id").withColumns({"_nf": nf, "_rn": rn})
    scaled = {f: ratio(F.col(f), F.col("_nf")) for f in SPEED_SCALED}
    scaled |= {f: F.col(f) * F.col("_rn") for f in RATE_SCALED}
    return joined.withColumns(scaled).drop("_nf", "_rn", "polling_rate")


def window_features(
    events: DataFrame,
    sessions: DataFrame,
    window_ms: float = WINDOW_MS,
    bucket_ms: float = ACTIVE_BUCKET_MS,
    slices: int = 1,
) -> DataFrame:
    """Events + sessions -> one row per non-empty window with metadata and features."""
    windowed = anchored_windows(events, window_ms, slices=slices)
    return normalise_devices(raw_window_features(windowed, GRAIN, bucket_ms, slices), sessions)
