"""Telemetry-shaped views of the warehouse tables.

The given tables hold no recordings, so ``events`` is read as one input session per
user: its event types become input kinds, ``value`` and ``props.k`` become pointer
coordinates, buttons and keys.  Every registered query starts from these views.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch_micros
from ..functions.ordered import Ordered, group_extent, measure_slices

DAY_MS = 86_400_000.0
VIEW_WINDOW_MS = 10 * DAY_MS

KIND_OF = {
    "view": "mouse_move",
    "click": "mouse_click",
    "signup": "mouse_scroll",
    "purchase": "key_press",
    "error": "key_release",
}
KEY_NAMES = ["w", "a", "s", "d", "e"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Telemetry:
    events: DataFrame
    sessions: DataFrame
    slices: int


def raw_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with typed columns; no ordering work yet."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])[F.col("event_type")]
    typed = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "user_id", "event_id", "value", k.alias("k"), "ts",
        epoch_micros(F.col("ts")).alias("us"),
        kind.alias("event_type"),
    )
    is_key = F.col("event_type").startswith("key")
    is_pos = F.col("event_type").isin("mouse_move", "mouse_click")
    is_click = F.col("event_type") == "mouse_click"
    names = F.array(*map(F.lit, KEY_NAMES))
    return typed.select(
        "session_id", "user_id", "event_id", "us", "event_type", "k", "value",
        F.when(is_pos, F.round("value").cast("int")).alias("x"),
        F.when(is_pos, F.col("k").cast("int")).alias("y"),
        F.when(is_click, F.when(F.col("k") % 2 == 0, "left").otherwise("right")).alias("button"),
        F.when(is_click, F.col("k") % 4 != 0).alias("pressed"),
        F.when(is_key, F.element_at(names, (F.col("k") % 5 + 1).cast("int"))).alias("key"),
    )


def session_slices(spark: SparkSession, sf_dir: str) -> int:
    return measure_slices(table(spark, sf_dir, "events"), ["user_id"])


def telemetry(spark: SparkSession, sf_dir: str, slices: int | None = None) -> Telemetry:
    slices = session_slices(spark, sf_dir) if slices is None else slices
    raw = raw_inputs(spark, sf_dir)
    timed = group_extent(raw, ["session_id"], {"us0": F.min("us")}, slices).withColumn(
        "t", (F.col("us") - F.col("us0")) / F.lit(1000.0)
    )
    numbered = Ordered(("session_id",), ("us", "event_id"), slices).apply(timed, position="seq")
    moving = numbered.withColumn("is_move", F.col("event_type") == "mouse_move")
    stepped = Ordered(("session_id", "is_move"), ("t", "seq"), slices).apply(
        moving, lag={"px": "x", "py": "y"}
    )
    move, scroll = F.col("is_move"), F.col("event_type") == "mouse_scroll"
    dx = F.when(move, F.coalesce(F.col("x") - F.col("px"), F.lit(0))).when(scroll, 0)
    dy = F.when(move, F.coalesce(F.col("y") - F.col("py"), F.lit(0))).when(
        scroll, F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    )
    events = stepped.select(
        "session_id", "user_id", "seq", "t", "event_type", "x", "y",
        dx.cast("int").alias("dx"), dy.cast("int").alias("dy"),
        "button", "pressed", "key", "us", "k", "value",
    )
    return Telemetry(events, sessions_view(raw), slices)


def sessions_view(raw: DataFrame) -> DataFrame:
    """One row per session, from a map-side combined aggregate."""
    agg = raw.groupBy("session_id", "user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        ((F.max("us") - F.min("us")) / F.lit(1000.0)).alias("duration_ms"),
        F.min("us").alias("recorded_us"),
    )
    u = F.col("user_id")
    label = F.when(u % 10 == 3, "aimbot").when(u % 10 == 7, "triggerbot").otherwise("legit")
    return agg.select(
        "session_id", "user_id",
        F.concat(F.lit("p"), (u % 5).cast("string")).alias("player"),
        F.when(u % 2 == 0, "Arena Shooter").otherwise(" Open World ").alias("game"),
        F.when(u % 3 == 0, None).when(u % 3 == 1, "combat").otherwise("unknown").alias("activity"),
        label.alias("cheat_label"),
        (label != "legit").alias("is_cheat_session"),
        (F.lit(0.5) + F.lit(0.5) * (u % 4)).alias("sensitivity"),
        (F.lit(400) * (1 + u % 3)).cast("int").alias("dpi"),
        F.when(u % 7 == 0, None)
        .otherwise(F.lit(125) * F.pow(F.lit(2), (u % 4)).cast("int")).cast("int")
        .alias("polling_rate"),
        F.timestamp_micros("recorded_us").alias("recorded_at"),
        "recorded_us", "duration_ms", "event_count",
    )
