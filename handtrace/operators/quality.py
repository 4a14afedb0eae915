"""Validation, quarantine and metadata checks on recorded sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EVENT_KINDS, FEATURES, MIN_DURATION_MS, MIN_EVENTS
from ..functions.exprs import ratio
from ..functions.ordered import Ordered, exact_percentiles

# ---- fixed values: required document fields and their JSON token types ----
REQUIRED_FIELDS = {
    "session_id": "string", "player": "string", "game": "string", "sensitivity": "float",
    "dpi": "int", "recorded_at": "string", "duration_ms": "float", "event_count": "int",
    "events": "array",
}
KNOWN_ACTIVITIES = ["on_foot", "driving", "combat", "sniping", "free_roam"]
MIN_SESSION_S, MAX_SESSION_S = 60.0, 900.0
SENSITIVITY_OUTLIER = 10.0

_TOKEN = {
    "string": r"^STRING$", "float": r"^(DECIMAL|DOUBLE|FLOAT)", "int": r"^(BIGINT|INT|SMALLINT|TINYINT)$",
    "array": r"^ARRAY",
}


def document_errors(
    doc: Column,
    n_events: Column | None = None,
    strict_types: bool = True,
    fields: dict[str, str] | None = None,
) -> Column:
    """Array of error codes for one session document (VARIANT), NULL if not JSON.

    JSON ``1`` is an integer token and ``1.0`` a float token; with ``strict_types``
    the two are not interchangeable.
    """
    fields = REQUIRED_FIELDS if fields is None else fields
    checks = []
    for name, kind in fields.items():
        value = F.variant_get(doc, f"$.{name}", "variant")
        checks.append(F.when(value.isNull(), F.lit(f"missing:{name}")))
        if strict_types:
            wrong = ~F.schema_of_variant(value).rlike(_TOKEN[kind])
            checks.append(F.when(value.isNotNull() & wrong, F.lit(f"type:{name}")))
    if n_events is None:
        n_events = F.size(F.try_variant_get(doc, "$.events", "array<variant>"))
    duration = F.try_variant_get(doc, "$.duration_ms", "double")
    checks += volume_checks(n_events, duration)
    errors = F.array_compact(F.array(*checks))
    return F.when(doc.isNull(), F.array(F.lit("corrupt"))).otherwise(errors)


def volume_checks(n_events: Column, duration_ms: Column) -> list[Column]:
    return [
        F.when(n_events == 0, F.lit("events:empty")),
        F.when((n_events > 0) & (n_events < MIN_EVENTS), F.lit("events:few")),
        F.when(duration_ms < MIN_DURATION_MS, F.lit("duration:short")),
    ]


def quarantine(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; nothing is lost."""
    return df.filter(F.size(errors) == 0), df.filter(F.size(errors) > 0)


def normalise_metadata(sessions: DataFrame) -> DataFrame:
    """Canonical player and game names."""
    return sessions.withColumns({
        "player": F.lower(F.trim("player")),
        "game": F.replace(F.lower(F.trim("game")), F.lit(" "), F.lit("_")),
    })


def parse_utc(text: Column) -> Column:
    return F.try_to_timestamp(text)


def is_cheat(typed_spans: Column, untyped_spans: Column, label: Column) -> Column:
    """Any labelled span, or a session label other than empty/legit."""
    return (
        (F.coalesce(typed_spans, F.lit(0)) > 0)
        | (F.coalesce(untyped_spans, F.lit(0)) > 0)
        | ~F.coalesce(F.lower(F.trim(label)), F.lit("")).isin("", "legit")
    )


def coerce_events(parsed: DataFrame) -> DataFrame:
    """Keep known kinds, turn unusable numbers into NULL, missing time into 0."""
    number = lambda c: F.round(F.col(c).try_cast("double")).try_cast("int").alias(c)
    return parsed.filter(F.col("type").isin(EVENT_KINDS)).select(
        "session_id", "seq",
        F.coalesce(F.col("t").try_cast("double"), F.lit(0.0)).alias("t"),
        F.col("type").alias("event_type"),
        *[number(c) for c in ("x", "y", "dx", "dy")],
        "button", F.col("pressed").try_cast("boolean").alias("pressed"), "key",
    )


def count_mismatch(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Declared against actual number of events."""
    actual = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("actual"))
    return (
        sessions.select("session_id", F.col("event_count").alias("declared"))
        .join(actual, "session_id", "left")
        .withColumn("actual", F.coalesce("actual", F.lit(0)))
        .withColumn("mismatch", F.col("declared") != F.col("actual"))
    )


def unknown_kinds(events: DataFrame, kind: str = "type") -> DataFrame:
    """Kinds outside the known five, per session, sorted."""
    return (
        events.filter(~F.col(kind).isin(EVENT_KINDS))
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_set(kind)).alias("unknown_kinds"))
    )


def out_of_order(events: DataFrame, slices: int = 1) -> DataFrame:
    """Events earlier than their predecessor in array order."""
    lagged = Ordered(("session_id",), ("seq",), slices).apply(events, lag={"_pt": "t"})
    return lagged.groupBy("session_id").agg(
        F.sum(F.when(F.col("t") < F.col("_pt"), 1).otherwise(0)).alias("out_of_order")
    )


def metadata_flags(sessions: DataFrame) -> DataFrame:
    """Per-session warning and failure flags."""
    seconds = F.col("duration_ms") / 1000.0
    return sessions.withColumns({
        "warn_activity_missing": F.col("activity").isNull(),
        "warn_activity_unknown": F.coalesce(~F.col("activity").isin(KNOWN_ACTIVITIES), F.lit(False)),
        "warn_polling_missing": F.col("polling_rate").isNull(),
        "warn_short": F.coalesce(seconds < MIN_SESSION_S, F.lit(False)),
        "warn_long": F.coalesce(seconds > MAX_SESSION_S, F.lit(False)),
        "fail_sensitivity": F.coalesce(F.col("sensitivity") <= 0, F.lit(False)),
        "fail_dpi": F.coalesce(F.col("dpi") <= 0, F.lit(False)),
    })


def batch_flags(sessions: DataFrame, min_sessions: int, slices: int = 1) -> DataFrame:
    """Checks that compare a session with the whole batch.

    The batch statistics are two one-row frames and one row per player.
    """
    rates = sessions.agg(F.count_distinct("polling_rate").alias("_rates"))
    per_player = sessions.filter(F.col("player").isNotNull()).groupBy("player").agg(
        F.count(F.lit(1)).alias("player_sessions"))
    positive = sessions.filter(F.col("sensitivity") > 0)
    median = exact_percentiles(positive, [], {"_median": ("sensitivity", 0.5)}, slices)
    usable = positive.agg(F.count(F.lit(1)).alias("_n"))
    off = F.greatest(
        ratio(F.col("sensitivity"), F.col("_median")), ratio(F.col("_median"), F.col("sensitivity")))
    return (
        sessions.crossJoin(F.broadcast(rates))       # one row
        .crossJoin(F.broadcast(median))              # one row
        .crossJoin(F.broadcast(usable))              # one row
        .join(per_player, "player", "left")
        .withColumns({
            "warn_mixed_polling": F.col("_rates") > 1,
            "warn_few_sessions": F.coalesce(F.col("player_sessions") < min_sessions, F.lit(False)),
            "warn_sensitivity_outlier": F.coalesce(
                (F.col("_n") >= 2) & (F.col("sensitivity") > 0) & (off > SENSITIVITY_OUTLIER),
                F.lit(False)),
        })
        .drop("_rates", "_median", "_n")
    )


def status(flags: DataFrame, strict: bool = False) -> DataFrame:
    """FAIL / WARN / PASS from the ``fail_*`` and ``warn_*`` columns."""
    any_of = lambda prefix: F.greatest(
        *[F.col(c).cast("int") for c in flags.columns if c.startswith(prefix)], F.lit(0), F.lit(0)) > 0
    verdict = F.when(any_of("fail_"), "FAIL").when(any_of("warn_"), "WARN").otherwise("PASS")
    out = flags.withColumn("status", verdict)
    rejected = F.col("status") == "FAIL"
    if strict:
        rejected = F.col("status") != "PASS"
    return out.withColumn("rejected", rejected)


def status_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.col("rejected").cast("int")).alias("rejected"))


def pointer_events(raw: DataFrame, slices: int = 1) -> DataFrame:
    """Plain pointer rows ``(session_id, seq, t, button, state, x, y)`` -> input events.

    Movement rows gain deltas from the previous movement (first one 0), presses and
    releases become clicks, scroll rows a signed ``dy``; other states are dropped.
    """
    state = F.col("state")
    moving = state.isin("Move", "Drag")
    known = raw.filter(state.isin("Move", "Drag", "Pressed", "Released", "Up", "Down")).withColumn(
        "_move", moving)
    lagged = Ordered(("session_id", "_move"), ("t", "seq"), slices).apply(
        known, lag={"_px": "x", "_py": "y"})
    scroll = state.isin("Up", "Down")
    kind = (
        F.when(moving, "mouse_move").when(scroll, "mouse_scroll").otherwise("mouse_click"))
    dx = F.when(moving, F.coalesce(F.col("x") - F.col("_px"), F.lit(0))).when(scroll, 0)
    dy = F.when(moving, F.coalesce(F.col("y") - F.col("_py"), F.lit(0))).when(
        scroll, F.when(state == "Up", 1).otherwise(-1))
    click = state.isin("Pressed", "Released")
    return lagged.select(
        "session_id", "seq", "t", kind.alias("event_type"), "x", "y",
        dx.cast("int").alias("dx"), dy.cast("int").alias("dy"),
        F.when(click, F.lower("button")).alias("button"),
        F.when(click, state == "Pressed").alias("pressed"),
        F.lit(None).cast("string").alias("key"),
    )


def drop_sentinels(events: DataFrame, sentinel: int = 65535) -> DataFrame:
    """Remove rows whose coordinates are the corpus' out-of-range marker."""
    bad = (F.col("x") == sentinel) | (F.col("y") == sentinel)
    return events.filter(~F.coalesce(bad, F.lit(False)))


def session_envelope(events: DataFrame) -> DataFrame:
    """Session rows for corpora without metadata."""
    return events.groupBy("session_id").agg(
        F.max("t").alias("duration_ms"), F.count(F.lit(1)).alias("event_count"),
    ).withColumns({"sensitivity": F.lit(1.0), "dpi": F.lit(800)})


def null_rates(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, null_rate); aggregated in one pass, then turned upright."""
    rates = features.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "feature", "null_rate")


def strip_keys(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the key events of control keys; rows without a key stay."""
    return events.filter(~F.coalesce(F.col("key"), F.lit("")).isin(list(keys)))
