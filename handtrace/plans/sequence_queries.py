"""Segments, runs, chunks, channels, labels and joins over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import joins, labels, sequence as sq, signals, windows as win
from ..sources.tables import DAY_MS, VIEW_WINDOW_MS, telemetry
from .registry import query, r
from .views import events_sql, sessions_sql, with_sql, windows_sql

GAP = 2 * DAY_MS
CHUNK = 8
TOGGLES = {"e": "macro", "w": "aimbot"}


@query("anchored_windows", windows_sql(f"""
  SELECT session_id, window_idx, {r('w_start', 'w_start', 3)}, {r('w_ms', 'w_ms', 3)}, count(*) AS n
  FROM win GROUP BY session_id, window_idx, win.w_start, win.w_ms"""))
def anchored_windows(spark, sf):
    tele = telemetry(spark, sf)
    w = win.anchored_windows(tele.events, VIEW_WINDOW_MS, slices=tele.slices)
    return rounded(w.groupBy("session_id", "window_idx", "w_start", "w_ms").agg(F.count(F.lit(1)).alias("n")), 3)


_SEGMENTS = f"""
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) > {GAP} THEN 1 ELSE 0 END AS nw FROM ev),
seg AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM gaps),
kept AS (SELECT * FROM (SELECT *, max(t) OVER g - min(t) OVER g AS span FROM seg WINDOW g AS (PARTITION BY session_id, segment))
         WHERE span >= {DAY_MS})"""


@query("idle_segments", with_sql("events", _SEGMENTS.strip(), f"""
  SELECT session_id, segment, count(*) AS n, {r('min(t)', 't_first', 3)}, {r('max(t)', 't_last', 3)}
  FROM kept GROUP BY 1, 2"""))
def idle_segments(spark, sf):
    tele = telemetry(spark, sf)
    seg = win.idle_segments(tele.events, GAP, DAY_MS, tele.slices)
    return rounded(seg.groupBy("session_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last")), 3)


@query("segment_windows", with_sql("events", _SEGMENTS.strip() + f""",
  sw AS (SELECT *, floor((t - min(t) OVER g) / {3 * DAY_MS})::INT AS window_idx, min(t) OVER g AS t0, max(t) OVER g AS t1
         FROM kept WINDOW g AS (PARTITION BY session_id, segment))""", f"""
  SELECT session_id, segment, window_idx, count(*) AS n FROM sw
  WHERE least({3 * DAY_MS}, t1 - (t0 + window_idx * {3 * DAY_MS})) > 0 GROUP BY 1, 2, 3"""))
def segment_windows(spark, sf):
    tele = telemetry(spark, sf)
    seg = win.idle_segments(tele.events, GAP, DAY_MS, tele.slices)
    w = win.anchored_windows(seg, 3 * DAY_MS, ("session_id", "segment"), tele.slices)
    return w.groupBy("session_id", "segment", "window_idx").agg(F.count(F.lit(1)).alias("n"))


_TICKS = """
ticks AS (SELECT session_id, (k % 2)::INT AS cheater, floor(t / 3600000.0)::BIGINT AS tick, seq FROM ev),
uniq AS (SELECT session_id, cheater, tick, min(seq) AS seq FROM ticks GROUP BY 1, 2, 3),
runs AS (SELECT *, sum(nw) OVER (PARTITION BY session_id, cheater ORDER BY tick ROWS UNBOUNDED PRECEDING)::BIGINT AS run
  FROM (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY session_id, cheater ORDER BY tick) > 24 THEN 1 ELSE 0 END AS nw FROM uniq))"""


@query("contiguous_runs", with_sql("events", _TICKS.strip(), """
  SELECT session_id, cheater, run, count(*) AS n, min(tick) AS first_tick, max(tick) AS last_tick, sum(seq)::BIGINT AS seqs
  FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 4"""))
def contiguous_runs(spark, sf):
    tele = telemetry(spark, sf)
    ticks = tele.events.select(
        "session_id", (F.col("k") % 2).cast("int").alias("cheater"), F.floor(F.col("t") / 3600000.0).alias("tick"), "seq")
    runs = win.contiguous_runs(ticks, ["session_id", "cheater"], ["seq"], max_gap=24, min_rows=4, slices=tele.slices)
    return runs.groupBy("session_id", "cheater", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"),
        F.sum("seq").alias("seqs"))


@query("overlapping_chunks", events_sql(f"""
  , sized AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ev),
  starts AS (SELECT session_id, unnest(range(0, n - {CHUNK} + 1, {CHUNK // 2})) AS start_seq
             FROM (SELECT session_id, any_value(n) AS n FROM sized GROUP BY 1) WHERE n >= {CHUNK})
  SELECT s.session_id, (start_seq // {CHUNK // 2})::BIGINT AS chunk_idx, start_seq::BIGINT AS start_seq, count(*) AS n,
    {r('min(t)', 't_first', 3)}, {r('max(t)', 't_last', 3)}
  FROM starts s JOIN ev e ON e.session_id = s.session_id AND e.seq >= start_seq AND e.seq < start_seq + {CHUNK}
  GROUP BY s.session_id, start_seq"""))
def overlapping_chunks(spark, sf):
    tele = telemetry(spark, sf)
    m = win.chunk_membership(tele.events, CHUNK, CHUNK // 2, slices=tele.slices)
    return rounded(m.groupBy("session_id", "chunk_idx", "start_seq").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last")), 3)


_CHANNELS = """
ch AS (
  SELECT e.session_id, e.seq, e.t, ln(1 + greatest(coalesce(t - lag(t) OVER (PARTITION BY session_id ORDER BY seq), 0), 0)) AS dt,
    CASE WHEN event_type IN ('mouse_move','mouse_scroll') THEN coalesce(dx, 0) / nf ELSE 0 END AS dx,
    CASE WHEN event_type IN ('mouse_move','mouse_scroll') THEN coalesce(dy, 0) / nf ELSE 0 END AS dy,
    (event_type = 'mouse_move')::INT::DOUBLE AS is_mouse_move,
    (event_type = 'mouse_click' AND coalesce(pressed, false))::INT::DOUBLE AS is_mouse_click_press,
    (event_type = 'mouse_scroll')::INT::DOUBLE AS is_mouse_scroll,
    (event_type = 'key_press')::INT::DOUBLE AS is_key_press, (event_type = 'key_release')::INT::DOUBLE AS is_key_release
  FROM ev e JOIN (SELECT session_id, greatest(sensitivity * dpi / 800.0::DOUBLE, 1e-6) AS nf FROM sess) USING (session_id))"""
_CH_COLS = ", ".join(r(c, c) for c in sq.CHANNEL_NAMES)


def channels(spark, sf):
    tele = telemetry(spark, sf)
    return sq.event_channels(tele.events, tele.sessions, tele.slices), tele


@query("event_channels", with_sql("sessions", _CHANNELS.strip(), f"SELECT session_id, seq, {_CH_COLS} FROM ch"))
def event_channels(spark, sf):
    return rounded(channels(spark, sf)[0].drop("t"))


_FIT = """
st AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, avg({c}) AS mean, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS std FROM ch"
    for c in sq.CHANNEL_NAMES) + ")"


@query("normaliser_fit", with_sql("sessions", _CHANNELS.strip() + "," + _FIT.strip(),
                                  f"SELECT channel, {r('mean', 'mean')}, {r('std', 'std')} FROM st"))
def normaliser_fit(spark, sf):
    return rounded(sq.fit_normaliser(channels(spark, sf)[0]))


_SCALED = ", ".join(
    r(f"({c} - (SELECT mean FROM st WHERE channel = '{c}')) / (SELECT std FROM st WHERE channel = '{c}')", c, 5)
    for c in sq.CHANNEL_NAMES)


@query("normaliser_apply", with_sql("sessions", _CHANNELS.strip() + "," + _FIT.strip(),
                                    f"SELECT session_id, seq, {_SCALED} FROM ch"))
def normaliser_apply(spark, sf):
    ch = channels(spark, sf)[0].drop("t")
    return rounded(sq.apply_normaliser(ch, sq.fit_normaliser(ch)), 5)


@query("normaliser_json", with_sql("sessions", _CHANNELS.strip() + "," + _FIT.strip(), """
  SELECT channel, round(mean * 1000000)::BIGINT AS mean_micro, round(std * 1000000)::BIGINT AS std_micro FROM st"""))
def normaliser_json(spark, sf):
    """Statistics written as JSON text and read back."""
    stats = sq.fit_normaliser(channels(spark, sf)[0])
    text = stats.select(F.to_json(F.struct("channel", "mean", "std")).alias("j"))
    back = text.select(F.from_json("j", "channel STRING, mean DOUBLE, std DOUBLE").alias("s")).select("s.*")
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(f"{c}_micro")
    return back.select("channel", micro("mean"), micro("std"))


_MILLI = "array_to_string(list_transform(flatten(list([{}] ORDER BY seq)), lambda x: round(x * 1000)::BIGINT::VARCHAR), ',')".format(
    ", ".join(sq.CHANNEL_NAMES))


@query("chunk_assembly", with_sql("sessions", _CHANNELS.strip(), f"""
  SELECT session_id, (seq // {CHUNK})::BIGINT AS chunk_idx, (seq // {CHUNK} * {CHUNK})::BIGINT AS start_seq, {_MILLI} AS v
  FROM ch GROUP BY 1, 2, 3 HAVING count(*) = {CHUNK}"""))
def chunk_assembly(spark, sf):
    ch, tele = channels(spark, sf)
    chunks = sq.assemble_chunks(ch, CHUNK, slices=tele.slices)
    text = F.array_join(F.transform("v", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return chunks.withColumn("v", text)


@query("chunk_counts", events_sql(f"""
  SELECT session_id, (count(*) // {CHUNK})::BIGINT AS chunks FROM ev GROUP BY 1 HAVING count(*) >= {CHUNK}"""))
def chunk_counts(spark, sf):
    ch, tele = channels(spark, sf)
    return sq.chunk_counts(win.chunk_membership(ch, CHUNK, slices=tele.slices)
                           .select("session_id", "chunk_idx").distinct())


_SAMPLED = """
sm AS (
  SELECT session_id, seq, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(pressed, false) AS down,
         lag(coalesce(x, 0)) OVER w AS px, lag(coalesce(y, 0)) OVER w AS py, lag(coalesce(pressed, false)) OVER w AS pd,
         row_number() OVER w AS rn
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq))"""


def samples(spark, sf):
    tele = telemetry(spark, sf)
    zero = F.lit(0)
    return tele.events.select(
        "session_id", "seq", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"),
        F.coalesce("pressed", F.lit(False)).alias("down")), tele


@query("sampled_channels", with_sql("events", _SAMPLED.strip(), f"""
  SELECT session_id, seq, {r('CASE WHEN rn = 1 THEN 0 ELSE ln(1 + 15.625::DOUBLE) END', 'dt')},
    coalesce(x - px, 0)::DOUBLE AS dx, coalesce(y - py, 0)::DOUBLE AS dy,
    (down AND NOT coalesce(pd, false))::INT::DOUBLE AS is_mouse_click_press FROM sm"""))
def sampled_channels(spark, sf):
    s, tele = samples(spark, sf)
    ch = sq.sampled_channels(s, ["session_id"], "seq", F.lit(15.625), tele.slices)
    return rounded(ch.select("session_id", "seq", "dt", "dx", "dy", "is_mouse_click_press"))


@query("dt_override", with_sql("sessions", _CHANNELS.strip(), f"""
  SELECT session_id, {r('sum(ln(1 + 8.0::DOUBLE))', 'dt_const')}, 0.0::DOUBLE AS dt_zero FROM ch GROUP BY 1"""))
def dt_override(spark, sf):
    ch = channels(spark, sf)[0]
    const = sq.override_dt(ch, 8.0).groupBy("session_id").agg(F.sum("dt").alias("dt_const"))
    zero = sq.override_dt(ch, None).groupBy("session_id").agg(F.sum("dt").alias("dt_zero"))
    return rounded(const.join(zero, "session_id"))


@query("capture_channels")
def capture_channels(spark, sf):
    """Nested captures (arrays of ticks derived from ``events``) exploded to channels."""
    s, tele = samples(spark, sf)
    per_day = s.withColumn("day", F.floor(F.col("seq") / 64)).groupBy("session_id", "day").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("seq").alias("sampleIndex"), "x", "y", F.col("down").alias("isDown")))).alias("tickInputs"))
    captures = per_day.select(
        F.concat_ws("-", "session_id", "day").alias("session_id"), "tickInputs",
        (F.col("day") % 5 == 4).alias("touchscreen"), F.lit(1000.0).alias("duration"),
        F.size("tickInputs").alias("physicsTickCount"))
    ticks = sq.nested_tick_samples(captures, min_ticks=16)
    return rounded(sq.sampled_channels(ticks, ["session_id", "ms_per_tick"], "seq", F.col("ms_per_tick")).drop("ms_per_tick"))


@query("capture_kinematics", with_sql("events", """
  sp AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d
         FROM (SELECT session_id, seq, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(pressed, false) AS down FROM ev)
         WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
  ac AS (SELECT *, d * 240 AS speed, abs(d * 240 - lag(d * 240) OVER (PARTITION BY session_id ORDER BY seq)) AS accel FROM sp)""", f"""
  SELECT session_id, {r('avg(speed)', 'speed_mean', 4)}, {r('stddev_samp(speed)', 'speed_std', 4)},
    {r('avg(accel)', 'accel_mean', 4)}, {r('stddev_samp(accel)', 'accel_std', 4)},
    {r('sum(d) / greatest(sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2)), 1e-9)', 'jitter', 2)},
    count(*) AS n_ticks, sum(down::INT)::BIGINT AS n_clicks FROM ac GROUP BY 1 HAVING count(*) >= 3"""))
def capture_kinematics(spark, sf):
    s, tele = samples(spark, sf)
    k = signals.capture_kinematics(s, "seq", tele.slices).withColumn("jitter", F.round("jitter", 2))
    return rounded(k, 4)


@query("trajectory", with_sql("sessions", _CHANNELS.strip(), f"""
  SELECT session_id, seq, {r('sum(dx) OVER w', 'px', 5)}, {r('sum(dy) OVER w', 'py', 5)} FROM ch
  WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""))
def trajectory(spark, sf):
    ch, tele = channels(spark, sf)
    return rounded(sq.integrate(ch, tele.slices).select("session_id", "seq", "px", "py"), 5)


@query("chunk_augmentation")
def chunk_augmentation(spark, sf):
    ch, tele = channels(spark, sf)
    chunks = sq.assemble_chunks(ch, CHUNK, slices=tele.slices)
    view = sq.augment(chunks, seed=1, length=CHUNK)
    stats = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rounded(view.select("session_id", "chunk_idx", stats.alias("total")))


@query("session_sample", sessions_sql("""
  SELECT session_id FROM sess
  ORDER BY ('0x' || substr(md5('42|' || session_id), 1, 15))::BIGINT, session_id LIMIT 24"""))
def session_sample(spark, sf):
    return sq.sample_sessions(telemetry(spark, sf).sessions, 24).select("session_id")


@query("normaliser_fit_sampled", with_sql("sessions", _CHANNELS.strip() + """,
  few AS (SELECT session_id FROM sess ORDER BY ('0x' || substr(md5('42|' || session_id), 1, 15))::BIGINT, session_id LIMIT 24)""",
  " UNION ALL ".join(
      f"SELECT '{c}' AS channel, {r(f'avg({c})', 'mean')}, {r(f'CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END', 'std')} FROM ch WHERE session_id IN (SELECT session_id FROM few)"
      for c in sq.CHANNEL_NAMES)))
def normaliser_fit_sampled(spark, sf):
    """The sampling fit operator: statistics from 24 sessions chosen by keyed hash."""
    ch, tele = channels(spark, sf)
    few = sq.sample_sessions(tele.sessions, 24).select("session_id")
    return rounded(sq.fit_normaliser(joins.keep_known(ch, few, "session_id")))


_SPANS = """
pr AS (SELECT session_id, CASE key WHEN 'e' THEN 'macro' ELSE 'aimbot' END AS cheat, t, seq,
         row_number() OVER w AS rn, lead(t) OVER w AS nx
       FROM ev WHERE event_type = 'key_press' AND key IN ('e', 'w') WINDOW w AS (PARTITION BY session_id, key ORDER BY t, seq)),
spans AS (SELECT session_id, t AS start_ms, coalesce(nx, duration_ms) AS end_ms, cheat
          FROM pr JOIN sess USING (session_id) WHERE rn % 2 = 1 AND coalesce(nx, duration_ms) > t)"""


def spans_of(tele):
    return labels.toggle_spans(tele.events, TOGGLES, slices=tele.slices)


@query("toggle_spans", with_sql("sessions", _SPANS.strip(), f"""
  SELECT session_id, {r('start_ms', 'start_ms', 3)}, {r('end_ms', 'end_ms', 3)}, cheat FROM spans"""))
def toggle_spans(spark, sf):
    return rounded(spans_of(telemetry(spark, sf)), 3)


@query("dominant_cheat", with_sql("sessions", _SPANS.strip(), f"""
  SELECT session_id, arg_min(cheat, (-a, cheat)) AS label, {r('max(a)', 'active_ms', 3)}
  FROM (SELECT session_id, cheat, sum(end_ms - start_ms) AS a FROM spans GROUP BY 1, 2) GROUP BY 1"""))
def dominant_cheat(spark, sf):
    return rounded(labels.dominant_label(spans_of(telemetry(spark, sf))), 3)


@query("session_cheat_labels", with_sql("sessions", _SPANS.strip(), """
  SELECT s.session_id, coalesce(array_to_string(list_sort(c), ','), '') AS cheats,
    CASE WHEN c IS NULL THEN 'legit' WHEN len(c) = 1 THEN c[1] ELSE 'mixed' END AS label
  FROM sess s LEFT JOIN (SELECT session_id, list(DISTINCT cheat) AS c FROM spans GROUP BY 1) USING (session_id)"""))
def session_cheat_labels(spark, sf):
    tele = telemetry(spark, sf)
    return labels.session_labels(tele.sessions, spans_of(tele)).withColumn("cheats", F.array_join("cheats", ","))


@query("merged_spans", with_sql("sessions", _SPANS.strip() + """,
  wide AS (SELECT session_id, start_ms, end_ms + 86400000.0 AS end_ms, cheat FROM spans),
  isl AS (SELECT *, sum(CASE WHEN reach >= start_ms THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, cheat ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, max(end_ms) OVER (PARTITION BY session_id, cheat ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide))""", f"""
  SELECT session_id, cheat, {r('min(start_ms)', 'start_ms', 3)}, {r('max(end_ms)', 'end_ms', 3)} FROM isl GROUP BY session_id, cheat, g"""))
def merged_spans(spark, sf):
    tele = telemetry(spark, sf)
    wide = spans_of(tele).withColumn("end_ms", F.col("end_ms") + DAY_MS)
    return rounded(joins.merge_spans(wide, tele.slices), 3)


@query("interval_join", with_sql("sessions", _SPANS.strip(), """
  SELECT e.session_id, cheat, count(DISTINCT e.seq) AS n, sum(DISTINCT e.seq)::BIGINT AS seqs
  FROM ev e JOIN spans s ON e.session_id = s.session_id AND e.t BETWEEN start_ms AND end_ms GROUP BY 1, 2"""))
def interval_join(spark, sf):
    tele = telemetry(spark, sf)
    hit = joins.interval_join(tele.events.select("session_id", "t", "seq"), spans_of(tele), tele.slices)
    return hit.groupBy("session_id", "cheat").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


_CHUNK_HITS = f"""
mem AS (SELECT session_id, seq // {CHUNK} AS chunk_idx, seq, t FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
        WHERE seq < n // {CHUNK} * {CHUNK}),
hits AS (SELECT m.session_id, chunk_idx, cheat, count(DISTINCT seq) AS h
         FROM mem m JOIN spans s ON m.session_id = s.session_id AND t BETWEEN start_ms AND end_ms GROUP BY 1, 2, 3)"""


def members_of(tele):
    return win.chunk_membership(tele.events, CHUNK, slices=tele.slices).select("session_id", "chunk_idx", "seq", "t")


@query("chunk_cheat_labels", with_sql("sessions", _SPANS.strip() + "," + _CHUNK_HITS.strip(), """
  SELECT c.session_id, c.chunk_idx::BIGINT AS chunk_idx, coalesce(label, '') AS label, coalesce(hits, 0)::BIGINT AS hits
  FROM (SELECT DISTINCT session_id, chunk_idx FROM mem) c
  LEFT JOIN (SELECT session_id, chunk_idx, arg_min(cheat, (-h, cheat)) AS label, max(h) AS hits FROM hits GROUP BY 1, 2) USING (session_id, chunk_idx)"""))
def chunk_cheat_labels(spark, sf):
    tele = telemetry(spark, sf)
    return labels.chunk_labels(members_of(tele), spans_of(tele), tele.slices)


@query("chunk_cheat_flags", with_sql("sessions", _SPANS.strip() + "," + _CHUNK_HITS.strip(), """
  SELECT session_id, count(*) AS chunks, sum(f)::BIGINT AS flagged FROM (
    SELECT m.session_id, m.chunk_idx, max((h.h IS NOT NULL)::INT) AS f
    FROM mem m LEFT JOIN hits h USING (session_id, chunk_idx) GROUP BY 1, 2) GROUP BY 1"""))
def chunk_cheat_flags(spark, sf):
    tele = telemetry(spark, sf)
    flags = labels.chunk_flags(members_of(tele), spans_of(tele), tele.slices)
    return flags.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.col("contains_cheat").cast("long")).alias("flagged"))


_RESOLVE = """
res AS (
  SELECT session_id, 100.0::DOUBLE AS start_ms, 200.0 + user_id AS end_ms, 'macro' AS cheat FROM sess WHERE user_id % 4 = 0 AND user_id % 8 <> 0
  UNION ALL SELECT session_id, 300.0, 400.0, 'aimbot' FROM sess WHERE user_id % 4 = 0
  UNION ALL SELECT session_id, 10.0, 20.0, cheat_label FROM sess WHERE user_id % 4 <> 0 AND cheat_label <> 'legit'
  UNION ALL SELECT session_id, 30.0, 40.0, cheat_label FROM sess WHERE user_id % 4 <> 0 AND cheat_label <> 'legit')"""


@query("resolved_spans", with_sql("sessions", _RESOLVE.strip(), f"""
  SELECT session_id, {r('start_ms', 'start_ms')}, {r('end_ms', 'end_ms')}, cheat FROM res"""))
def resolved_spans(spark, sf):
    """Typed spans for every fourth session (some flagged accidental), untyped for the rest."""
    u = F.col("user_id")
    lit = F.lit
    typed = F.array(
        F.struct(lit(100.0).alias("start_ms"), (lit(200.0) + u).alias("end_ms"), lit("macro").alias("cheat"),
                 (u % 8 == 0).alias("accidental")),
        F.struct(lit(300.0).alias("start_ms"), lit(400.0).alias("end_ms"), lit("aimbot").alias("cheat"),
                 lit(None).cast("boolean").alias("accidental")))
    s = telemetry(spark, sf).sessions.withColumns({
        "cheat_segments_typed": F.when(u % 4 == 0, typed),
        "cheat_segments": F.array(F.array(lit(10.0), lit(20.0)), F.array(lit(30.0), lit(40.0)))})
    return rounded(labels.resolve_spans(s, drop_accidental=True))


@query("difficulty_and_base", sessions_sql("""
  SELECT session_id,
    CASE user_id % 5 WHEN 0 THEN 'soft' WHEN 1 THEN 'medium' WHEN 4 THEN 'obvious' END AS difficulty,
    CASE user_id % 5 WHEN 3 THEN session_id || '_rec_extra' ELSE session_id || '_rec' END AS base
  FROM sess"""))
def difficulty_and_base(spark, sf):
    s = telemetry(spark, sf).sessions
    case = F.col("user_id") % 5
    suffix = (F.when(case == 0, "_aimbot_soft.json").when(case == 1, "_aimbot_medium.json")
              .when(case == 2, "_legit.json").when(case == 3, "_extra.json").otherwise("_macro.json"))
    name = F.concat(F.col("session_id"), F.lit("_rec"), suffix)
    return s.select("session_id", labels.difficulty(F.when(case == 4, "Obvious"), name).alias("difficulty"),
                    labels.base_recording(name).alias("base"))


@query("difficulty_pools", sessions_sql("""
  SELECT pool, cheat_label, count(*) AS n, sum(event_count)::BIGINT AS events FROM (
    SELECT cheat_label, event_count, unnest(CASE WHEN user_id % 3 = 0 THEN ['all'] WHEN user_id % 3 = 1 THEN ['soft', 'all'] ELSE ['obvious', 'all'] END) AS pool
    FROM sess) GROUP BY 1, 2"""))
def difficulty_pools(spark, sf):
    u = F.col("user_id")
    s = telemetry(spark, sf).sessions.withColumn(
        "difficulty", F.when(u % 3 == 1, "soft").when(u % 3 == 2, "obvious"))
    return labels.pooled_by_difficulty(s).groupBy("pool", "cheat_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("events"))


@query("asof_key_release", windows_sql(f"""
  SELECT p.session_id, p.window_idx, p.seq, {r('p.t', 't', 3)}, {r('q.t', 'release_t', 3)}
  FROM (SELECT * FROM win WHERE event_type = 'key_press') p
  ASOF LEFT JOIN (SELECT * FROM win WHERE event_type = 'key_release') q
    ON p.session_id = q.session_id AND p.window_idx = q.window_idx AND p.key = q.key AND p.t <= q.t"""))
def asof_key_release(spark, sf):
    tele = telemetry(spark, sf)
    w = win.anchored_windows(tele.events, VIEW_WINDOW_MS, slices=tele.slices)
    keys = ["session_id", "window_idx", "key"]
    press = w.filter("event_type = 'key_press'").select(*keys, "t", "seq")
    release = w.filter("event_type = 'key_release'").select(*keys, "t").withColumn("release_t", F.col("t"))
    got = joins.asof_forward(press, release, keys, "release_t", out="release_t", slices=tele.slices)
    return rounded(got.select("session_id", "window_idx", "seq", "t", "release_t"), 3)


def _reaction_sql(keys: str, select: str) -> str:
    return windows_sql(f"""
  SELECT {select}, seq, {r('t - m', 'reaction', 3)} FROM (
    SELECT *, last_value(CASE WHEN event_type = 'mouse_move' THEN t END IGNORE NULLS) OVER (
      PARTITION BY {keys} ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {'win' if 'window' in keys else 'ev'})
  WHERE event_type = 'mouse_click' AND pressed""")


@query("click_reaction_window", _reaction_sql("session_id, window_idx", "session_id, window_idx"))
def click_reaction_window(spark, sf):
    tele = telemetry(spark, sf)
    w = win.anchored_windows(tele.events, VIEW_WINDOW_MS, slices=tele.slices)
    moved = F.when(F.col("event_type") == "mouse_move", F.col("t"))
    seen = joins.last_before(w, ["session_id", "window_idx"], moved, "m", tele.slices)
    clicks = seen.filter("event_type = 'mouse_click' AND pressed")
    return rounded(clicks.select("session_id", "window_idx", "seq", (F.col("t") - F.col("m")).alias("reaction")), 3)


@query("click_reaction_session", _reaction_sql("session_id", "session_id"))
def click_reaction_session(spark, sf):
    tele = telemetry(spark, sf)
    return rounded(signals.click_reaction(tele.events, tele.slices).drop("t"), 3)


@query("range_moves_before_click", events_sql(f"""
  SELECT c.session_id, c.seq, count(m.seq) AS points, {r('coalesce(sum(m.x), 0)', 'total', 3)}
  FROM (SELECT * FROM ev WHERE event_type = 'mouse_click' AND pressed) c
  LEFT JOIN (SELECT * FROM ev WHERE event_type = 'mouse_move') m
    ON m.session_id = c.session_id AND m.t BETWEEN c.t - {2 * DAY_MS} AND c.t GROUP BY 1, 2"""))
def range_moves_before_click(spark, sf):
    tele = telemetry(spark, sf)
    kind = F.col("event_type")
    return rounded(joins.range_aggregate_within(
        tele.events, (kind == "mouse_click") & F.col("pressed"), kind == "mouse_move", 2 * DAY_MS, "x", slices=tele.slices), 3)


@query("session_signals", with_sql("sessions", f"""
  mv AS (SELECT session_id, t, seq, x, y, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(t) OVER w AS t1,
           lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2, lag(t, 2) OVER w AS t2
         FROM ev WHERE event_type = 'mouse_move' WINDOW w AS (PARTITION BY session_id ORDER BY t, seq)),
  tr AS (SELECT *, sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) AS n1, sqrt(pow(x - x1, 2) + pow(y - y1, 2)) AS n2 FROM mv WHERE t2 IS NOT NULL),
  an AS (SELECT session_id, t, t2, acos(greatest(-1.0, least(1.0, ((x - x1) * (x1 - x2) + (y - y1) * (y1 - y2)) / (n1 * n2)))) AS a
         FROM tr WHERE n1 > 1e-6 AND n2 > 1e-6),
  aim AS (SELECT c.session_id, c.seq, avg(a) AS cv FROM ev c JOIN an ON an.session_id = c.session_id AND an.t <= c.t AND an.t2 >= c.t - {5 * DAY_MS}
          WHERE c.event_type = 'mouse_click' AND c.pressed GROUP BY 1, 2),
  rx AS (SELECT *, last_value(CASE WHEN event_type = 'mouse_move' THEN t END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
  kp AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM ev WHERE event_type = 'key_press')""", f"""
  SELECT s.session_id, {r('aim_curvature', 'aim_curvature', 5)}, {r('median_reaction', 'median_reaction', 3)}, {r('key_interval_cv', 'key_interval_cv')}
  FROM sess s LEFT JOIN (SELECT session_id, avg(cv) AS aim_curvature FROM aim GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, median(t - m) AS median_reaction FROM rx WHERE event_type = 'mouse_click' AND pressed GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, stddev_pop(g) / (avg(g) + 1e-9) AS key_interval_cv FROM kp GROUP BY 1) USING (session_id)"""))
def session_signals(spark, sf):
    tele = telemetry(spark, sf)
    s = signals.session_signals(tele.events, tele.sessions, 5 * DAY_MS, tele.slices)
    s = s.withColumns({"aim_curvature": F.round("aim_curvature", 5), "median_reaction": F.round("median_reaction", 3)})
    return rounded(s)


@query("player_baseline", with_sql("sessions", """
  st AS (SELECT player, sqrt(pow(dx, 2) + pow(dy, 2)) AS m FROM ev JOIN sess USING (session_id) WHERE event_type = 'mouse_move'),
  kp AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY seq) AS g FROM ev WHERE event_type = 'key_press')""", f"""
  SELECT p.player, {r('coalesce(m, 2.0)', 'move_step_scale')}, {r('coalesce(cv, 0.6)', 'key_interval_cv')}
  FROM (SELECT DISTINCT player FROM sess) p
  LEFT JOIN (SELECT player, median(m) AS m FROM st WHERE m > 0 GROUP BY 1) USING (player)
  LEFT JOIN (SELECT player, CASE WHEN count(*) >= 2 THEN stddev_pop(g) / avg(g) END AS cv FROM kp JOIN sess USING (session_id) WHERE g > 0 GROUP BY 1) USING (player)"""))
def player_baseline(spark, sf):
    tele = telemetry(spark, sf)
    return rounded(signals.player_baseline(tele.events, tele.sessions, tele.slices))


def _tick_inputs(tele):
    z = F.lit(0.0)
    k, v = F.col("k").cast("double"), F.col("value")
    on = lambda name: F.when(F.col("event_type") == name, 1.0).otherwise(0.0)
    return tele.events.select(
        "session_id", "seq",
        F.coalesce(F.col("dx").cast("double"), z).alias("mdx"), F.coalesce(F.col("dy").cast("double"), z).alias("mdy"),
        (k * 3.6 - 180.0).alias("yaw"), F.pmod(v, F.lit(90.0)).alias("pitch"),
        on("mouse_click").alias("fire"), on("mouse_scroll").alias("rclick"),
        *[F.when(F.floor(F.col("k") / b) % 2 == 1, 1.0).otherwise(0.0).alias(n)
          for n, b in (("fwd", 1), ("back", 2), ("left", 4), ("right", 8))],
        (v / 10.0).alias("accuracy_penalty"), v.alias("velocity"), (k + 5.0).alias("ping"))


_TICK_SQL = f"""
ti AS (SELECT session_id, seq, coalesce(dx, 0)::DOUBLE AS mdx, coalesce(dy, 0)::DOUBLE AS mdy, k * 3.6::DOUBLE - 180.0 AS yaw, fmod(value, 90.0::DOUBLE) AS pitch,
  (event_type = 'mouse_click')::INT AS fire, (event_type = 'mouse_scroll')::INT AS rclick,
  (k // 1) % 2 AS f1, (k // 2) % 2 AS f2, (k // 4) % 2 AS f3, (k // 8) % 2 AS f4,
  value / 10.0 AS accuracy_penalty, value AS velocity, k + 5.0::DOUBLE AS ping, count(*) OVER (PARTITION BY session_id) AS n FROM ev),
st AS (SELECT session_id, unnest(range(0, max(n) - 16 + 1, 8)) AS s0 FROM ti GROUP BY 1 HAVING max(n) >= 16),
tm AS (SELECT ti.*, (s0 // 8)::BIGINT AS chunk_idx FROM st JOIN ti ON ti.session_id = st.session_id AND seq >= s0 AND seq < s0 + 16),
t1 AS (SELECT *, sqrt(mdx * mdx + mdy * mdy) AS speed, lag(mdx) OVER w AS pdx, lag(mdy) OVER w AS pdy,
  sqrt(pow(fmod(fmod(yaw - lag(yaw) OVER w + 180, 360.0::DOUBLE) + 360, 360.0::DOUBLE) - 180, 2) + pow(pitch - lag(pitch) OVER w, 2)) AS av
  FROM tm WINDOW w AS (PARTITION BY session_id, chunk_idx ORDER BY seq)),
t2 AS (SELECT *, sqrt(pdx * pdx + pdy * pdy) AS pspeed, abs(av - lag(av) OVER w) AS aa, abs(speed - lag(speed) OVER w) AS ds, f1 + f2 + f3 + f4 AS held
  FROM t1 WINDOW w AS (PARTITION BY session_id, chunk_idx ORDER BY seq)),
t3 AS (SELECT *, CASE WHEN speed > 1e-6 AND pspeed > 1e-6 THEN acos(greatest(-1.0, least(1.0, (mdx * pdx + mdy * pdy) / (speed * pspeed)))) END AS turn,
  quantile_cont(speed, 0.75) OVER g AS cut, CASE WHEN stddev_pop(av) OVER g > 0 THEN avg(av) OVER g + 2 * stddev_pop(av) OVER g END AS lim
  FROM t2 WINDOW g AS (PARTITION BY session_id, chunk_idx)),
tb AS (SELECT session_id, chunk_idx, avg(speed) AS sp_mean, stddev_pop(speed) AS sp_std, quantile_cont(speed, 0.5) AS sp_p50,
  quantile_cont(speed, 0.9) AS sp_p90, quantile_cont(speed, 0.99) AS sp_p99, avg(ds) AS speed_change,
  sum(speed) / greatest(sqrt(pow(sum(mdx), 2) + pow(sum(mdy), 2)), 1.0) AS jitter, coalesce(avg(turn), 0) AS curv_mean, coalesce(stddev_pop(turn), 0) AS curv_std,
  coalesce(sqrt(pow(sum(mdx) FILTER (speed > cut), 2) + pow(sum(mdy) FILTER (speed > cut), 2)) / nullif(sum(speed) FILTER (speed > cut), 0), 0) AS fast_segment_straightness,
  avg(av) AS av_mean, stddev_pop(av) AS av_std, quantile_cont(av, 0.99) AS av_p99, avg(aa) AS aa_mean, sum((av > lim)::INT)::BIGINT AS flicks0,
  avg(fire) AS fire_rate, avg(rclick) AS rclick_rate, avg(held / 4.0) AS move_rate, avg((held > 1)::INT) AS key_overlap,
  quantile_cont(yaw, 0.5) AS yaw_p50, quantile_cont(yaw, 0.75) - quantile_cont(yaw, 0.25) AS yaw_iqr,
  quantile_cont(pitch, 0.5) AS pit_p50, quantile_cont(pitch, 0.75) - quantile_cont(pitch, 0.25) AS pit_iqr,
  stddev_pop(yaw) AS yaw_std, stddev_pop(pitch) AS pitch_std, max(yaw) - min(yaw) AS yaw_range, max(pitch) - min(pitch) AS pitch_range,
  avg(accuracy_penalty) AS accpen_mean, avg(velocity) AS velocity_mean, avg(ping) AS ping, coalesce(sum((av > lim)::INT), 0)::BIGINT AS flicks
  FROM t3 GROUP BY 1, 2)"""


def tick_bank(spark, sf):
    tele = telemetry(spark, sf)
    members = win.chunk_membership(_tick_inputs(tele), 16, 8, slices=tele.slices)
    return signals.tick_window_bank(members, ["session_id", "chunk_idx"])


@query("tick_window_bank", with_sql("events", _TICK_SQL.strip(), "SELECT session_id, chunk_idx, " + ", ".join(
    c if c == "flicks" else r(c, c, 8) for c in signals.TICK_BANK) + " FROM tb"))
def tick_window_bank(spark, sf):
    return rounded(tick_bank(spark, sf).select("session_id", "chunk_idx", *signals.TICK_BANK), 8)


@query("tick_identity_bank", with_sql("events", _TICK_SQL.strip(), "SELECT session_id, chunk_idx, " + ", ".join(
    r(c, c, 8) for c in signals.IDENTITY_BANK) + " FROM tb"))
def tick_identity_bank(spark, sf):
    return rounded(tick_bank(spark, sf).select("session_id", "chunk_idx", *signals.IDENTITY_BANK), 8)


@query("press_spectrum")
def press_spectrum(spark, sf):
    """Magnitude spectrum of press counts, 64 bins per session."""
    return rounded(signals.press_spectrum(telemetry(spark, sf).events, 64), 4)
