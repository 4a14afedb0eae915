"""Outcome-telemetry queries; the four tables are read out of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import OUTCOME_FEATURES
from ..functions.exprs import rounded
from ..operators import features as feat, joins, outcome as oc, stats
from ..sources.tables import DAY_MS, VIEW_WINDOW_MS, telemetry
from .registry import query, r
from .views import events_sql, with_sql
from .window_queries import feature_table

RATE = 1.0 / 60.0  # one tick per minute
HZ = 1.0 / 86400.0  # daily grid


def outcome_tables(tele) -> oc.Outcomes:
    e = tele.events.withColumn("tick", F.floor(F.col("t") / 60000.0))
    me = F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))
    other = F.concat(F.lit("p"), ((F.col("user_id") + F.col("k")) % 5).cast("string"))
    of = lambda kind: e.filter(F.col("event_type") == kind)
    return oc.Outcomes(
        kills=of("key_release").select("session_id", "tick", me.alias("attacker_name"), other.alias("user_name"),
                                       (F.col("k") % 4 == 0).alias("headshot")),
        hurts=of("mouse_click").select("session_id", "tick", me.alias("attacker_name"), F.col("value").alias("dmg_health"),
                                       F.when(F.col("k") % 3 == 0, "head").otherwise("chest").alias("hitgroup")),
        fires=of("key_press").select("session_id", "tick", me.alias("user_name")),
        angles=of("mouse_move").select("session_id", me.alias("name"), "tick", F.pmod("value", F.lit(90.0)).alias("pitch"),
                                       (F.col("k") * 3.6 - 180.0).alias("yaw")),
        tick_rate=RATE)


_TABLES = """
src AS (SELECT *, floor(t / 60000.0)::BIGINT AS tick, 'p' || (user_id % 5) AS me, 'p' || ((user_id + k) % 5) AS other FROM ev),
ang AS (SELECT session_id, me AS player, tick, fmod(value, 90.0::DOUBLE) AS pitch, k * 3.6::DOUBLE - 180.0 AS yaw FROM src WHERE event_type = 'mouse_move'),
al AS (SELECT *, lag(tick) OVER w AS pt, lag(yaw) OVER w AS py, lag(pitch) OVER w AS pp FROM ang
       WINDOW w AS (PARTITION BY session_id, player ORDER BY tick, yaw, pitch)),
vel AS (SELECT session_id, player, tick * 60.0::DOUBLE AS time_s,
          sqrt(pow(fmod(fmod(yaw - py + 180, 360.0::DOUBLE) + 360, 360.0::DOUBLE) - 180, 2) + pow(pitch - pp, 2)) / ((tick - pt) * 60.0::DOUBLE) AS angvel
        FROM al WHERE tick - pt > 0)"""


@query("view_angle_speed", with_sql("events", _TABLES.strip(), f"""
  SELECT session_id, player, count(*) AS n, {r('sum(time_s)', 'time_s', 3)}, {r('avg(angvel) * 1000', 'angvel')}, {r('max(angvel) * 1000', 'peak')}
  FROM vel GROUP BY 1, 2"""))
def view_angle_speed(spark, sf):
    tele = telemetry(spark, sf)
    v = oc.view_speed(outcome_tables(tele).angles, RATE, tele.slices)
    g = v.groupBy("session_id", "player").agg(
        F.count(F.lit(1)).alias("n"), F.sum("time_s").alias("time_s"),
        (F.avg("angvel") * 1000).alias("angvel"), (F.max("angvel") * 1000).alias("peak"))
    return rounded(g.withColumn("time_s", F.round("time_s", 3)))


def _outcome_sql(offset: str) -> str:
    w = f"floor((s - {offset}) / 864000.0::DOUBLE)::INT"
    return f"""
rows_ AS (
  SELECT session_id, me AS player, tick * 60.0::DOUBLE AS s, 1 AS kills, 0 AS deaths, (k % 4 = 0)::INT AS hs, 0 AS hits, 0.0::DOUBLE AS dmg, 0 AS head, 0 AS shots, NULL::DOUBLE AS av FROM src WHERE event_type = 'key_release'
  UNION ALL SELECT session_id, other, tick * 60.0, 0, 1, 0, 0, 0, 0, 0, NULL FROM src WHERE event_type = 'key_release'
  UNION ALL SELECT session_id, me, tick * 60.0, 0, 0, 0, 1, value, (k % 3 = 0)::INT, 0, NULL FROM src WHERE event_type = 'mouse_click'
  UNION ALL SELECT session_id, me, tick * 60.0, 0, 0, 0, 0, 0, 0, 1, NULL FROM src WHERE event_type = 'key_press'
  UNION ALL SELECT session_id, player, time_s, 0, 0, 0, 0, 0, 0, 0, angvel FROM vel),
ow AS (
  SELECT session_id, player, {w} AS window_idx, sum(kills)::DOUBLE AS kills, sum(deaths)::DOUBLE AS deaths, sum(shots)::DOUBLE AS shots_fired,
    sum(hits)::DOUBLE AS hits_dealt, sum(dmg)::DOUBLE AS damage_dealt,
    coalesce(sum(hits) / nullif(sum(shots), 0)::DOUBLE, 0) AS accuracy, coalesce(sum(dmg) / nullif(sum(shots), 0)::DOUBLE, 0) AS damage_per_shot,
    CASE WHEN sum(hits) > 0 THEN sum(head) / sum(hits)::DOUBLE ELSE coalesce(sum(hs) / nullif(sum(kills), 0)::DOUBLE, 0) END AS headshot_ratio,
    coalesce(sum(kills) / nullif(sum(shots), 0)::DOUBLE, 0) AS kills_per_shot,
    coalesce(quantile_cont(av, 0.5), 0) AS view_angvel_p50, coalesce(quantile_cont(av, 0.99), 0) AS view_angvel_p99,
    coalesce(max(av), 0) AS view_angvel_max, sum((coalesce(av, 0) > 500)::INT)::DOUBLE AS flick_count
  FROM rows_ GROUP BY 1, 2, 3)"""


_OC = ", ".join(r(c, c) for c in OUTCOME_FEATURES)


@query("outcome_windows", with_sql("events", _TABLES.strip() + "," + _outcome_sql("0.0").strip(),
                                   f"SELECT session_id, player, window_idx, {_OC} FROM ow"))
def outcome_windows(spark, sf):
    tele = telemetry(spark, sf)
    return rounded(oc.outcome_windows(outcome_tables(tele), VIEW_WINDOW_MS, slices=tele.slices))


@query("outcome_windows_offset", with_sql("events", _TABLES.strip() + "," + _outcome_sql("500000.0").strip(),
                                          f"SELECT session_id, player, window_idx, {_OC} FROM ow"))
def outcome_windows_offset(spark, sf):
    """A positive clock offset moves early activity into negative windows."""
    tele = telemetry(spark, sf)
    offsets = tele.sessions.select("session_id", F.lit(500000.0).alias("offset_s"))
    return rounded(oc.outcome_windows(outcome_tables(tele), VIEW_WINDOW_MS, offsets, tele.slices))


@query("tick_seconds", events_sql(f"""
  SELECT session_id, {r('max(floor(t / 60000.0) * 60.0::DOUBLE)', 'last_s', 3)} FROM ev GROUP BY 1"""))
def tick_seconds(spark, sf):
    e = telemetry(spark, sf).events
    s = oc.tick_seconds(F.floor(F.col("t") / 60000.0), RATE)
    return rounded(e.groupBy("session_id").agg(F.max(s).alias("last_s")), 3)


@query("most_active_player", events_sql("""
  SELECT session_id, arg_min(player, (-n, player)) AS player, max(n) AS shots FROM (
    SELECT session_id, 'p' || ((user_id + k) % 5) AS player, count(*) AS n FROM ev WHERE event_type = 'key_press' GROUP BY 1, 2) GROUP BY 1"""))
def most_active_player(spark, sf):
    e = telemetry(spark, sf).events.filter("event_type = 'key_press'")
    fires = e.select("session_id", F.concat(F.lit("p"), ((F.col("user_id") + F.col("k")) % 5).cast("string")).alias("user_name"))
    return oc.most_active(fires)


_SERIES = """
dm AS (SELECT session_id, time_s AS s, angvel AS v FROM vel),
rl AS (SELECT session_id, t, sqrt(pow(dx, 2) + pow(dy, 2)) AS d, (t - lag(t) OVER (PARTITION BY session_id ORDER BY seq)) / 1000.0 AS dt
       FROM ev WHERE event_type = 'mouse_move'),
rs AS (SELECT session_id, (t - min(t) OVER (PARTITION BY session_id)) / 1000.0 AS s, d / dt AS v FROM rl WHERE dt > 0),
sp AS (SELECT 'demo' AS side, session_id, s, v FROM dm UNION ALL SELECT 'rec', session_id, s, v FROM rs),
ext AS (SELECT side, session_id, min(s) AS s0, greatest(2, ceil((max(s) - min(s)) / 86400.0)::INT + 1) AS n FROM sp GROUP BY 1, 2),
bins AS (SELECT sp.side, sp.session_id, least(floor((s - s0) / 86400.0)::INT, n - 1) AS i, avg(v) AS v FROM sp JOIN ext USING (side, session_id) GROUP BY ALL),
grid AS (SELECT g.side, g.session_id, g.i, s0, coalesce(b.v, 0) AS v
         FROM (SELECT side, session_id, s0, unnest(range(n))::INT AS i FROM ext) g LEFT JOIN bins b USING (side, session_id, i))"""


@query("motion_series", with_sql("events", _TABLES.strip() + "," + _SERIES.strip(), f"""
  SELECT side, session_id, i, {r('s0 + i * 86400.0::DOUBLE', 'grid_s', 3)}, {r('v * 1000', 'v')} FROM grid"""))
def motion_series(spark, sf):
    tele = telemetry(spark, sf)
    demo = oc.view_speed(outcome_tables(tele).angles, RATE, tele.slices).select("session_id", F.col("time_s").alias("s"), F.col("angvel").alias("v"))
    rec = oc.recorder_speed(tele.events, tele.slices)
    parts = [stats.resample(d, ["session_id"], HZ).withColumn("side", F.lit(n)) for d, n in ((demo, "demo"), (rec, "rec"))]
    both = parts[0].unionByName(parts[1]).withColumns({"grid_s": F.round("grid_s", 3), "v": F.col("v") * 1000})
    return rounded(both.select("side", "session_id", "i", "grid_s", "v"))


_CORR = """
st AS (SELECT side, session_id, avg(v) AS mu, count(*) AS n FROM grid GROUP BY 1, 2),
cn AS (SELECT g.side, g.session_id, i, v - mu AS c FROM grid g JOIN st USING (side, session_id) WHERE n >= 2),
un AS (SELECT side, session_id, i, c / sqrt(sum(c * c) OVER (PARTITION BY side, session_id)) AS u FROM cn
       QUALIFY sum(c * c) OVER (PARTITION BY side, session_id) > 0),
cc AS (SELECT a.session_id, a.i - b.i AS lag, sum(a.u * b.u) AS corr FROM un a JOIN un b USING (session_id)
       WHERE a.side = 'demo' AND b.side = 'rec' AND abs(a.i - b.i) <= 5 GROUP BY 1, 2),
bst AS (SELECT session_id, arg_min(lag, (-corr, lag)) AS lag, max(corr) AS peak FROM cc GROUP BY 1),
off AS (SELECT e.session_id, CASE WHEN b.lag IS NULL THEN 0 ELSE s0 + b.lag * 86400.0::DOUBLE END AS offset_s, coalesce(peak, 0) AS peak_corr, coalesce(b.lag, 0)::INT AS lag
  FROM (SELECT DISTINCT session_id FROM sp) e LEFT JOIN bst b USING (session_id) LEFT JOIN (SELECT session_id, s0 FROM ext WHERE side = 'demo') d USING (session_id)),
fix AS (SELECT off.* REPLACE (offset_s - coalesce(gap, 0) AS offset_s) FROM off LEFT JOIN (
  SELECT session_id, (min(t) FILTER (event_type = 'mouse_move') - min(t)) / 1000.0 AS gap FROM ev GROUP BY 1) USING (session_id))"""


def offsets(tele):
    demo = oc.view_speed(outcome_tables(tele).angles, RATE, tele.slices).select("session_id", F.col("time_s").alias("s"), F.col("angvel").alias("v"))
    return oc.clock_offsets(demo, oc.recorder_speed(tele.events, tele.slices), HZ, 5 * 86400.0, tele.slices)


_SYNC = _TABLES.strip() + "," + _SERIES.strip() + "," + _CORR.strip()


@query("clock_offsets", with_sql("events", _SYNC, f"""
  SELECT session_id, {r('offset_s', 'offset_s', 3)}, {r('peak_corr', 'peak_corr')}, lag FROM off"""))
def clock_offsets(spark, sf):
    return rounded(offsets(telemetry(spark, sf)).withColumn("offset_s", F.round("offset_s", 3)))


@query("anchored_offsets", with_sql("events", _SYNC, f"SELECT session_id, {r('offset_s', 'offset_s', 3)} FROM fix"))
def anchored_offsets(spark, sf):
    tele = telemetry(spark, sf)
    return rounded(oc.anchor_offsets(offsets(tele), tele.events).select("session_id", "offset_s"), 3)


_JOINED = """
aligned AS (SELECT f.session_id, f.window_idx, f.event_rate, o.session_id IS NOT NULL AS has_outcome, o.kills, o.hits_dealt, o.accuracy, o.view_angvel_p50
  FROM feat f LEFT JOIN ow o ON o.session_id = f.session_id AND o.window_idx = f.window_idx AND o.player = f.player)"""


@query("aligned_outcomes", with_sql("features", _TABLES.strip() + "," + _outcome_sql("0.0").strip() + "," + _JOINED.strip(), f"""
  SELECT session_id, window_idx, has_outcome, {r('event_rate', 'event_rate')}, {r('coalesce(kills, 0)', 'kills')}, {r('coalesce(hits_dealt, 0)', 'hits_dealt')},
    {r('coalesce(accuracy, 0)', 'accuracy')}, {r('coalesce(view_angvel_p50, 0)', 'view_angvel_p50')} FROM aligned"""))
def aligned_outcomes(spark, sf):
    tele = telemetry(spark, sf)
    inputs = feat.window_features(tele.events, tele.sessions, VIEW_WINDOW_MS, DAY_MS, tele.slices)
    table = oc.aligned_table(inputs, outcome_tables(tele), tele.sessions, None, VIEW_WINDOW_MS, tele.slices)
    return rounded(table.select("session_id", "window_idx", "has_outcome", "event_rate", "kills", "hits_dealt", "accuracy", "view_angvel_p50"))


@query("outcome_left_join", with_sql("windows", "o AS (SELECT session_id, window_idx, count(*) AS shots FROM win WHERE event_type = 'key_press' AND key = 'w' GROUP BY 1, 2)", """
  SELECT i.session_id, i.window_idx, o.shots IS NOT NULL AS has_outcome, coalesce(o.shots, 0)::BIGINT AS shots
  FROM (SELECT DISTINCT session_id, window_idx FROM win) i LEFT JOIN o USING (session_id, window_idx)"""))
def outcome_left_join(spark, sf):
    from ..operators.windows import anchored_windows
    tele = telemetry(spark, sf)
    w = anchored_windows(tele.events, VIEW_WINDOW_MS, slices=tele.slices)
    inputs = w.select("session_id", "window_idx").distinct()
    shots = w.filter("event_type = 'key_press' AND key = 'w'").groupBy("session_id", "window_idx").agg(F.count(F.lit(1)).alias("shots"))
    return joins.attach_outcome(inputs, shots, ["shots"])


@query("sync_verdict", with_sql("features", _SYNC + "," + _outcome_sql("0.0").strip() + "," + _JOINED.strip(), f"""
  SELECT x.session_id, {r('x.offset_s', 'offset_s', 3)}, {r('x.peak_corr', 'peak_corr')}, CASE WHEN x.peak_corr >= 0.5 THEN 'STRONG' ELSE 'WEAK' END AS verdict,
    coalesce(n, 0)::BIGINT AS input_windows, coalesce(m, 0)::BIGINT AS matched_windows
  FROM fix x LEFT JOIN (SELECT session_id, count(*) AS n, sum(has_outcome::INT) AS m FROM aligned GROUP BY 1) USING (session_id)"""))
def sync_verdict(spark, sf):
    tele = telemetry(spark, sf)
    off = oc.anchor_offsets(offsets(tele), tele.events)
    inputs = feature_table(spark, sf).select("session_id", "window_idx", "player")
    joined = oc.aligned_table(inputs, outcome_tables(tele), tele.sessions, None, VIEW_WINDOW_MS, tele.slices)
    v = oc.sync_verdict(off, inputs, joined)
    return rounded(v.withColumn("offset_s", F.round("offset_s", 3)))


@query("outcome_totals", with_sql("events", _TABLES.strip() + "," + _outcome_sql("0.0").strip(), f"""
  SELECT session_id, player, {', '.join(r(f'sum({c})', c) for c in ('kills', 'deaths', 'shots_fired', 'hits_dealt', 'damage_dealt', 'flick_count'))},
    {r('sum(headshot_ratio * greatest(hits_dealt, 1)) / sum(greatest(hits_dealt, 1))', 'headshot_ratio')}, {r('max(view_angvel_max)', 'view_angvel_max')}
  FROM ow GROUP BY 1, 2"""))
def outcome_totals(spark, sf):
    tele = telemetry(spark, sf)
    return rounded(oc.session_totals(oc.outcome_windows(outcome_tables(tele), VIEW_WINDOW_MS, slices=tele.slices)))


@query("outcome_player_rollup", events_sql(f"""
  SELECT 'p' || (user_id % 5) AS player, (k % 2)::INT AS label, max(k) AS kills, {r('max(value)', 'damage')},
    sum((event_type = 'key_press')::INT)::BIGINT AS active_shots, {r('median(k + 5)', 'ping')} FROM ev GROUP BY 1, 2"""))
def outcome_player_rollup(spark, sf):
    tele = telemetry(spark, sf)
    ticks = tele.events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("player"), (F.col("k") % 2).cast("int").alias("label"),
        F.col("k").alias("kills"), F.col("value").alias("damage"),
        (F.col("event_type") == "key_press").cast("int").alias("fire"), (F.col("k") + 5).cast("double").alias("ping"))
    return rounded(oc.player_rollup(ticks, tele.slices))
