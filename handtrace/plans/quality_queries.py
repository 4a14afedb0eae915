"""Validation and filtering queries (metadata documents are built from ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EVENT_KINDS, FEATURE_SLICES
from ..functions.exprs import rounded
from ..operators import features as feat
from ..operators import quality as q
from ..sources.tables import KEY_NAMES, raw_inputs, session_slices, sessions_view, table, telemetry
from .registry import query, r
from .views import events_sql, features_sql, sessions_sql, with_sql
from .window_queries import feature_table

_DOC_FIELDS = {k: v for k, v in q.REQUIRED_FIELDS.items() if k != "events"}


def documents(spark, sf):
    """One JSON metadata document per session, with faults that depend on the user."""
    s = sessions_view(raw_inputs(spark, sf))
    u = F.col("user_id")
    sens = F.when(u % 13 == 0, F.lit("1")).otherwise(
        F.col("sensitivity").cast("decimal(3,1)").cast("string"))
    dur = F.floor("duration_ms").cast("string")
    parts = F.concat(
        F.lit('{"session_id":"'), F.col("session_id"),
        F.when(u % 17 == 0, F.lit('"')).otherwise(F.concat(F.lit('","player":" '), F.upper("player"), F.lit(' "'))),
        F.lit(',"game":"'), F.col("game"), F.lit('","sensitivity":'), sens,
        F.lit(',"dpi":'), F.when(u % 19 == 0, F.lit('"800"')).otherwise(F.col("dpi").cast("string")),
        F.lit(',"recorded_at":"2024-01-01T00:00:00Z","duration_ms":'), dur,
        F.when(u % 11 == 0, F.lit("")).otherwise(F.lit(".0")),
        F.lit(',"event_count":'), F.col("event_count").cast("string"),
        F.when(u % 23 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return s.select("session_id", "user_id", "event_count", parts.alias("body"))


_DOCS_SQL = """
docs AS (
  SELECT session_id, user_id, event_count,
    '{"session_id":"' || session_id
    || CASE WHEN user_id % 17 = 0 THEN '"' ELSE '","player":" ' || upper(player) || ' "' END
    || ',"game":"' || game || '","sensitivity":'
    || CASE WHEN user_id % 13 = 0 THEN '1' ELSE sensitivity::DECIMAL(3,1)::VARCHAR END
    || ',"dpi":' || CASE WHEN user_id % 19 = 0 THEN '"800"' ELSE dpi::VARCHAR END
    || ',"recorded_at":"2024-01-01T00:00:00Z","duration_ms":' || floor(duration_ms)::BIGINT
    || CASE WHEN user_id % 11 = 0 THEN '' ELSE '.0' END
    || ',"event_count":' || event_count || CASE WHEN user_id % 23 = 0 THEN '' ELSE '}' END AS body
  FROM sess)"""


def _doc_error_sql() -> str:
    kinds = {"string": "('VARCHAR')", "float": "('DOUBLE')", "int": "('BIGINT','UBIGINT')"}
    parts = []
    for name, kind in _DOC_FIELDS.items():
        t = f"json_type(body, '$.{name}')"
        parts.append(f"CASE WHEN {t} IS NULL THEN 'missing:{name}' WHEN {t} NOT IN {kinds[kind]} THEN 'type:{name}' END")
    parts.append("CASE WHEN event_count = 0 THEN 'events:empty' WHEN event_count < 100 THEN 'events:few' END")
    parts.append("CASE WHEN json_extract(body, '$.duration_ms')::DOUBLE < 60000 THEN 'duration:short' END")
    return ("CASE WHEN NOT json_valid(body) THEN 'corrupt' ELSE concat_ws(';', "
            + ", ".join(parts) + ") END")


_CHECKED_SQL = f"""{_DOCS_SQL}, checked AS (
  SELECT *, {_doc_error_sql()} AS errors
  FROM (SELECT session_id, user_id, event_count, body FROM docs))"""


def checked_documents(spark, sf):
    docs = documents(spark, sf)
    errors = q.document_errors(F.try_parse_json("body"), F.col("event_count"), fields=_DOC_FIELDS)
    return docs.withColumn("errors", errors)


# DuckDB evaluates json_type on broken text, so corrupt rows are separated first.
_SAFE_CHECKED = _CHECKED_SQL.replace(
    "FROM (SELECT session_id, user_id, event_count, body FROM docs)",
    "FROM (SELECT session_id, user_id, event_count, CASE WHEN json_valid(body) THEN body END AS body FROM docs)",
).replace("NOT json_valid(body)", "body IS NULL")


@query("document_validation", with_sql("sessions", _SAFE_CHECKED.strip(),
                                       "SELECT session_id, errors FROM checked"))
def document_validation(spark, sf):
    return checked_documents(spark, sf).select(
        "session_id", F.concat_ws(";", "errors").alias("errors"))


@query("volume_rules", sessions_sql("""
  SELECT session_id, event_count, concat_ws(';',
    CASE WHEN event_count = 0 THEN 'events:empty' WHEN event_count < 100 THEN 'events:few' END,
    CASE WHEN duration_ms < 60000 THEN 'duration:short' END) AS errors FROM sess"""))
def volume_rules(spark, sf):
    s = sessions_view(raw_inputs(spark, sf))
    errors = F.array_compact(F.array(*q.volume_checks(F.col("event_count"), F.col("duration_ms"))))
    return s.select("session_id", "event_count", F.concat_ws(";", errors).alias("errors"))


@query("quarantine_counts", with_sql("sessions", _SAFE_CHECKED.strip(), """
  SELECT 'accepted' AS side, count(*) AS sessions, coalesce(sum(event_count), 0)::BIGINT AS events
  FROM checked WHERE errors = 'events:few' OR errors = ''
  UNION ALL
  SELECT 'rejected', count(*), coalesce(sum(event_count), 0)::BIGINT
  FROM checked WHERE NOT (errors = 'events:few' OR errors = '')"""))
def quarantine_counts(spark, sf):
    """The views hold short sessions only, so the 100-event rule is waived here."""
    waived = checked_documents(spark, sf).withColumn(
        "errors", F.array_except("errors", F.array(F.lit("events:few"))))
    good, bad = q.quarantine(waived)
    count = [F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events")]
    return (good.agg(*count).withColumn("side", F.lit("accepted"))
            .unionByName(bad.agg(*count).withColumn("side", F.lit("rejected"))))


@query("metadata_normalised", sessions_sql("""
  SELECT session_id, lower(trim(player)) AS player, replace(lower(trim(game)), ' ', '_') AS game,
         recorded_us FROM sess"""))
def metadata_normalised(spark, sf):
    s = q.normalise_metadata(sessions_view(raw_inputs(spark, sf)))
    return s.select("session_id", "player", "game", F.unix_micros("recorded_at").alias("recorded_us"))


def event_messages(spark, sf):
    """One JSON message per event, some with unusable numbers or unknown kinds."""
    raw = raw_inputs(spark, sf)
    kind = F.when(F.col("k") == 97, "focus_lost").when(F.col("k") == 98, "hotkey").otherwise(F.col("event_type"))
    x = F.when(F.col("k") % 9 == 0, '"n/a"').otherwise(F.coalesce(F.col("x").cast("string"), F.lit("null")))
    t = F.when(F.col("k") % 20 == 5, "").otherwise(
        F.concat(F.lit(',"t":'), F.col("event_id").cast("string"), F.lit(".0")))
    return raw.select("session_id", "event_id", F.concat(
        F.lit('{"type":"'), kind, F.lit('","x":'), x, t, F.lit("}")).alias("message"))


_MESSAGES = """
msg AS (
  SELECT session_id, event_id,
    CASE k WHEN 97 THEN 'focus_lost' WHEN 98 THEN 'hotkey' ELSE event_type END AS type,
    CASE WHEN k % 9 = 0 THEN NULL ELSE x END AS x,
    CASE WHEN k % 20 = 5 THEN 0 ELSE event_id::DOUBLE END AS t FROM raw)"""


def parsed_messages(spark, sf):
    fields = "type STRING, t STRING, x STRING, y STRING, dx STRING, dy STRING, button STRING, pressed STRING, key STRING"
    return (event_messages(spark, sf)
            .withColumn("m", F.from_json("message", fields))
            .select("session_id", F.col("event_id").alias("seq"), "m.*"))


@query("event_parsing", with_sql("events", _MESSAGES.strip(), f"""
  SELECT session_id, type AS event_type, count(*) AS n, count(x) AS n_x,
         coalesce(sum(x), 0)::BIGINT AS sum_x, {r('sum(t)', 'sum_t')}
  FROM msg WHERE type IN ({', '.join(repr(k) for k in EVENT_KINDS)}) GROUP BY 1, 2"""))
def event_parsing(spark, sf):
    ev = q.coerce_events(parsed_messages(spark, sf))
    return rounded(ev.groupBy("session_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_x"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("sum_x"), F.sum("t").alias("sum_t")))


@query("unknown_event_kinds", with_sql("events", _MESSAGES.strip(), f"""
  SELECT session_id, array_to_string(list_sort(list(DISTINCT type)), ',') AS unknown_kinds
  FROM msg WHERE type NOT IN ({', '.join(repr(k) for k in EVENT_KINDS)}) GROUP BY 1"""))
def unknown_event_kinds(spark, sf):
    return q.unknown_kinds(parsed_messages(spark, sf)).withColumn(
        "unknown_kinds", F.array_join("unknown_kinds", ","))


@query("cheat_session_flag", sessions_sql("""
  SELECT session_id, user_id % 6 = 0 OR user_id % 9 = 0
         OR coalesce(lower(trim(CASE WHEN cheat_label = 'legit' THEN ' Legit ' ELSE cheat_label END)), '') NOT IN ('', 'legit')
         AS cheat FROM sess"""))
def cheat_session_flag(spark, sf):
    s = sessions_view(raw_inputs(spark, sf))
    typed = F.when(F.col("user_id") % 6 == 0, 2)
    untyped = F.when(F.col("user_id") % 9 == 0, 1).otherwise(0)
    label = F.when(F.col("cheat_label") == "legit", " Legit ").otherwise(F.col("cheat_label"))
    return s.select("session_id", q.is_cheat(typed, untyped, label).alias("cheat"))


@query("event_count_mismatch", sessions_sql("""
  SELECT s.session_id, event_count AS declared, n AS actual, event_count <> n AS mismatch
  FROM sess s JOIN (SELECT session_id, count(*) FILTER (k % 50 <> 7) AS n FROM raw GROUP BY 1) a USING (session_id)"""))
def event_count_mismatch(spark, sf):
    raw = raw_inputs(spark, sf)
    return q.count_mismatch(sessions_view(raw), raw.filter(F.col("k") % 50 != 7))


@query("out_of_order_events", events_sql("""
  SELECT session_id, sum(CASE WHEN v < p THEN 1 ELSE 0 END)::BIGINT AS out_of_order FROM (
    SELECT session_id, value AS v, lag(value) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM ev) GROUP BY 1"""))
def out_of_order_events(spark, sf):
    """Array order is real, the clock is the ``value`` column, which jumps back."""
    tele = telemetry(spark, sf)
    return q.out_of_order(tele.events.withColumn("t", F.col("value")), tele.slices)


_FLAGS_SQL = """
flags AS (
  SELECT *, activity IS NULL AS warn_activity_missing,
    coalesce(activity NOT IN ('on_foot','driving','combat','sniping','free_roam'), false) AS warn_activity_unknown,
    polling_rate IS NULL AS warn_polling_missing, duration_ms / 1000 < 60 AS warn_short,
    duration_ms / 1000 > 900 AS warn_long, sensitivity <= 0 AS fail_sensitivity, dpi <= 0 AS fail_dpi
  FROM (SELECT * REPLACE (CASE WHEN user_id % 29 = 3 THEN -sensitivity WHEN user_id % 31 = 4 THEN sensitivity * 40 ELSE sensitivity END AS sensitivity) FROM sess)),
batch AS (
  SELECT f.*, (SELECT count(DISTINCT polling_rate) FROM flags) > 1 AS warn_mixed_polling,
    count(*) OVER (PARTITION BY player) AS player_sessions,
    count(*) OVER (PARTITION BY player) < 15 AS warn_few_sessions,
    coalesce((SELECT count(*) FROM flags WHERE sensitivity > 0) >= 2 AND sensitivity > 0
      AND greatest(sensitivity / m, m / sensitivity) > 10, false) AS warn_sensitivity_outlier
  FROM flags f, (SELECT median(sensitivity) AS m FROM flags WHERE sensitivity > 0))"""


def flagged(spark, sf):
    s = sessions_view(raw_inputs(spark, sf))
    u, sens = F.col("user_id"), F.col("sensitivity")
    return q.metadata_flags(s.withColumn(
        "sensitivity", F.when(u % 29 == 3, -sens).when(u % 31 == 4, sens * 40).otherwise(sens)))


_META_FLAGS = ["warn_activity_missing", "warn_activity_unknown", "warn_polling_missing",
               "warn_short", "warn_long", "fail_sensitivity", "fail_dpi"]
_BATCH_FLAGS = ["warn_mixed_polling", "warn_few_sessions", "warn_sensitivity_outlier"]


@query("metadata_warnings", with_sql("sessions", _FLAGS_SQL.strip(),
                                     f"SELECT session_id, {', '.join(_META_FLAGS)} FROM flags"))
def metadata_warnings(spark, sf):
    return flagged(spark, sf).select("session_id", *_META_FLAGS)


@query("batch_consistency", with_sql("sessions", _FLAGS_SQL.strip(),
                                     f"SELECT session_id, player_sessions, {', '.join(_BATCH_FLAGS)} FROM batch"))
def batch_consistency(spark, sf):
    return q.batch_flags(flagged(spark, sf), 15).select("session_id", "player_sessions", *_BATCH_FLAGS)


@query("status_rollup", with_sql("sessions", _FLAGS_SQL.strip(), """
  SELECT status, count(*) AS sessions, sum((status <> 'PASS')::INT)::BIGINT AS rejected FROM (
    SELECT CASE WHEN fail_sensitivity OR fail_dpi THEN 'FAIL'
                WHEN warn_activity_missing OR warn_activity_unknown OR warn_polling_missing OR warn_short
                  OR warn_few_sessions OR warn_sensitivity_outlier THEN 'WARN' ELSE 'PASS' END AS status FROM batch)
  GROUP BY 1"""))
def status_rollup(spark, sf):
    """Long sessions and mixed hardware are normal in the views, so both flags are waived."""
    flags = q.batch_flags(flagged(spark, sf), 15).drop("warn_long", "warn_mixed_polling")
    return q.status_summary(q.status(flags, strict=True))


@query("device_factors", sessions_sql(f"""
  SELECT session_id, {r('sensitivity * dpi / 800.0::DOUBLE', 'norm_factor')},
    {r('CASE WHEN polling_rate > 0 THEN 1000.0::DOUBLE / polling_rate ELSE 1 END', 'rate_norm')} FROM sess"""))
def device_factors(spark, sf):
    s = sessions_view(raw_inputs(spark, sf))
    return rounded(s.select(
        "session_id", feat.norm_factor(F.col("sensitivity"), F.col("dpi")).alias("norm_factor"),
        feat.rate_norm(F.col("polling_rate")).alias("rate_norm")))


_POINTER = """
ptr AS (
  SELECT session_id, seq, t, CASE event_type WHEN 'mouse_move' THEN CASE WHEN k % 3 = 0 THEN 'Drag' ELSE 'Move' END
      WHEN 'mouse_click' THEN CASE WHEN pressed THEN 'Pressed' ELSE 'Released' END
      WHEN 'mouse_scroll' THEN CASE WHEN k % 2 = 0 THEN 'Up' ELSE 'Down' END ELSE 'Idle' END AS state,
    CASE button WHEN 'left' THEN 'Left' WHEN 'right' THEN 'Right' END AS button,
    CASE WHEN k % 33 = 1 THEN 65535 ELSE coalesce(x, 0) END AS x, coalesce(y, 0) AS y
  FROM ev)"""


def pointer_rows(spark, sf):
    tele = telemetry(spark, sf)
    kind, k = F.col("event_type"), F.col("k")
    state = (
        F.when(kind == "mouse_move", F.when(k % 3 == 0, "Drag").otherwise("Move"))
        .when(kind == "mouse_click", F.when(F.col("pressed"), "Pressed").otherwise("Released"))
        .when(kind == "mouse_scroll", F.when(k % 2 == 0, "Up").otherwise("Down"))
        .otherwise("Idle"))
    return tele.events.select(
        "session_id", "seq", "t", state.alias("state"),
        F.initcap("button").alias("button"),
        F.when(k % 33 == 1, 65535).otherwise(F.coalesce("x", F.lit(0))).alias("x"),
        F.coalesce("y", F.lit(0)).alias("y")), tele.slices


@query("pointer_to_events", with_sql("events", _POINTER.strip(), f"""
  , moves AS (
    SELECT *, state IN ('Move','Drag') AS mv FROM ptr WHERE state <> 'Idle' AND x <> 65535 AND y <> 65535),
  conv AS (
    SELECT *, CASE WHEN mv THEN coalesce(x - lag(x) OVER w, 0) WHEN state IN ('Up','Down') THEN 0 END AS dx,
      CASE WHEN mv THEN coalesce(y - lag(y) OVER w, 0) WHEN state = 'Up' THEN 1 WHEN state = 'Down' THEN -1 END AS dy
    FROM moves WINDOW w AS (PARTITION BY session_id, mv ORDER BY t, seq))
  SELECT session_id, seq, {r('t', 't', 3)},
    CASE WHEN mv THEN 'mouse_move' WHEN state IN ('Up','Down') THEN 'mouse_scroll' ELSE 'mouse_click' END AS event_type,
    x::INT AS x, y::INT AS y, dx::DOUBLE AS dx, dy::DOUBLE AS dy,
    CASE WHEN state IN ('Pressed','Released') THEN lower(button) END AS button,
    CASE WHEN state IN ('Pressed','Released') THEN CASE state WHEN 'Pressed' THEN 'true' ELSE 'false' END END AS pressed FROM conv"""))
def pointer_to_events(spark, sf):
    rows, slices = pointer_rows(spark, sf)
    out = q.pointer_events(q.drop_sentinels(rows), slices).drop("key").withColumns({
        "dx": F.col("dx").cast("double"), "dy": F.col("dy").cast("double"),
        "pressed": F.col("pressed").cast("string")})
    return rounded(out, 3)


@query("session_envelopes", events_sql(f"""
  SELECT session_id, {r('max(t)', 'duration_ms', 3)}, count(*) AS event_count,
         1.0::DOUBLE AS sensitivity, 800 AS dpi FROM ev GROUP BY 1"""))
def session_envelopes(spark, sf):
    return rounded(q.session_envelope(telemetry(spark, sf).events), 3)


@query("feature_null_rates", features_sql("SELECT feature, " + r(
    "sum((v IS NULL)::INT) / count(*)::DOUBLE", "null_rate") + " FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM feat" for c in FEATURE_SLICES["cheat"]) + ") GROUP BY 1"))
def feature_null_rates(spark, sf):
    return rounded(q.null_rates(feature_table(spark, sf)))


def _slice_sql() -> str:
    parts = []
    for name in ("identification", "cheat", "mouse_only"):
        total = " + ".join(f"coalesce({c}, 0)" for c in FEATURE_SLICES[name] if c != "mouse_key_ratio")
        parts.append(f"SELECT '{name}' AS slice, {len(FEATURE_SLICES[name])} AS columns, "
                     f"{r(f'sum({total})', 'checksum', 2)} FROM feat")
    return features_sql(" UNION ALL ".join(parts))


@query("feature_slices", _slice_sql())
def feature_slices(spark, sf):
    """Every slice is a plain column list; its width and value checksum are reported."""
    f = feature_table(spark, sf)
    sums = f.agg(*[
        F.sum(sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                  for c in FEATURE_SLICES[n] if c != "mouse_key_ratio")).alias(n)
        for n in ("identification", "cheat", "mouse_only")])
    upright = sums.unpivot([], list(sums.columns), "slice", "checksum")
    width = F.create_map(*[x for n in sums.columns for x in (F.lit(n), F.lit(len(FEATURE_SLICES[n])))])
    return rounded(upright.withColumn("columns", width[F.col("slice")]), 2)


@query("control_key_strip", events_sql("""
  SELECT session_id, count(*) AS event_count FROM ev WHERE coalesce(key, '') <> 'e' GROUP BY 1"""))
def control_key_strip(spark, sf):
    kept = q.strip_keys(raw_inputs(spark, sf), ["e"])
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))


@query("column_projection", """
  SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS quantity
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1""")
def column_projection(spark, sf):
    """Three columns read, date filter pushed to the scan."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_shipdate")
    late = li.filter(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return rounded(late.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), 2)
