"""Feature-bank, window and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.exprs import rounded
from ..operators import features as feat
from ..operators import windows as win
from ..sources.tables import DAY_MS, VIEW_WINDOW_MS, telemetry
from .registry import query, r
from .views import events_sql, features_sql, with_sql, windows_sql

_FEATURE_LIST = ", ".join(
    r(f, f, 2 if f == "mouse_key_ratio" else 6) if f != "scroll_count" else f for f in FEATURES
)


def feature_table(spark, sf):
    tele = telemetry(spark, sf)
    return feat.window_features(tele.events, tele.sessions, VIEW_WINDOW_MS, DAY_MS, tele.slices)


def rounded_features(df):
    df = df.withColumn("mouse_key_ratio", F.round("mouse_key_ratio", 2))
    return rounded(df)


@query("window_features", features_sql(
    f"SELECT session_id, window_idx, player, is_cheat_session, {_FEATURE_LIST} FROM feat"))
def window_features(spark, sf):
    df = feature_table(spark, sf)
    return rounded_features(df.select("session_id", "window_idx", "player", "is_cheat_session", *FEATURES))
