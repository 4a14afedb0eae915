"""SQL twins of the telemetry views, shared by every oracle."""

EVENTS_CTE = """
typed AS (
  SELECT 'u' || user_id AS session_id, user_id, event_id, value,
         json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) AS us,
         CASE event_type WHEN 'view' THEN 'mouse_move' WHEN 'click' THEN 'mouse_click'
              WHEN 'signup' THEN 'mouse_scroll' WHEN 'purchase' THEN 'key_press'
              WHEN 'error' THEN 'key_release' END AS event_type
  FROM events),
raw AS (
  SELECT *, event_type = 'mouse_move' AS is_move,
         CASE WHEN event_type IN ('mouse_move','mouse_click') THEN round(value)::INT END AS x,
         CASE WHEN event_type IN ('mouse_move','mouse_click') THEN k::INT END AS y,
         CASE WHEN event_type = 'mouse_click' THEN CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END END AS button,
         CASE WHEN event_type = 'mouse_click' THEN k % 4 <> 0 END AS pressed,
         CASE WHEN event_type LIKE 'key%' THEN ['w','a','s','d','e'][k % 5 + 1] END AS key
  FROM typed),
numbered AS (
  SELECT *, (us - min(us) OVER (PARTITION BY session_id)) / 1000.0::DOUBLE AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) - 1 AS seq
  FROM raw),
ev AS (
  SELECT session_id, user_id, seq, t, event_type, x, y, button, pressed, key, us, k, value,
    CASE WHEN is_move THEN coalesce(x - lag(x) OVER w, 0) WHEN event_type = 'mouse_scroll' THEN 0 END::INT AS dx,
    CASE WHEN is_move THEN coalesce(y - lag(y) OVER w, 0)
         WHEN event_type = 'mouse_scroll' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END END::INT AS dy
  FROM numbered WINDOW w AS (PARTITION BY session_id, is_move ORDER BY t, seq))
"""

SESSIONS_CTE = """
sess0 AS (
  SELECT session_id, user_id, count(*) AS event_count,
         (max(us) - min(us)) / 1000.0::DOUBLE AS duration_ms, min(us) AS recorded_us
  FROM raw GROUP BY 1, 2),
sess AS (
  SELECT session_id, user_id, 'p' || (user_id % 5) AS player,
         CASE WHEN user_id % 2 = 0 THEN 'Arena Shooter' ELSE ' Open World ' END AS game,
         CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'combat' ELSE 'unknown' END AS activity,
         CASE WHEN user_id % 10 = 3 THEN 'aimbot' WHEN user_id % 10 = 7 THEN 'triggerbot' ELSE 'legit' END AS cheat_label,
         user_id % 10 IN (3, 7) AS is_cheat_session,
         0.5::DOUBLE + 0.5::DOUBLE * (user_id % 4) AS sensitivity,
         (400 * (1 + user_id % 3))::INT AS dpi,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE (125 * pow(2, user_id % 4))::INT END AS polling_rate,
         recorded_us, duration_ms, event_count
  FROM sess0)
"""

WINDOW = 864000000.0
BUCKET = 86400000.0

WINDOWED_CTE = f"""
win0 AS (
  SELECT *, floor((t - min(t) OVER s) / {WINDOW})::INT AS window_idx,
         min(t) OVER s AS t0, max(t) OVER s AS t1
  FROM ev WINDOW s AS (PARTITION BY session_id)),
win AS (
  SELECT * FROM (SELECT *, t0 + window_idx * {WINDOW} AS w_start,
                 least({WINDOW}, t1 - (t0 + window_idx * {WINDOW})) AS w_ms FROM win0)
  WHERE w_ms > 0)
"""

FEATURES_CTE = f"""
roles AS (
  SELECT *, CASE WHEN event_type = 'mouse_move' THEN 'move'
                 WHEN event_type = 'mouse_click' AND pressed THEN 'click'
                 WHEN event_type = 'key_press' THEN 'press' ELSE 'other' END AS role
  FROM win),
lag1 AS (
  SELECT *, lag(t) OVER w AS p_t, lag(x) OVER w AS p_x, lag(y) OVER w AS p_y,
         last_value(CASE WHEN event_type = 'mouse_move' THEN t END IGNORE NULLS)
           OVER (PARTITION BY session_id, window_idx ORDER BY t, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_move_t
  FROM roles WINDOW w AS (PARTITION BY session_id, window_idx, role ORDER BY t, seq)),
vec AS (
  SELECT *, CASE WHEN role = 'move' THEN sqrt(dx::DOUBLE * dx + dy::DOUBLE * dy) END AS dist,
         CASE WHEN role = 'move' THEN (x - p_x)::DOUBLE END AS vx,
         CASE WHEN role = 'move' THEN (y - p_y)::DOUBLE END AS vy,
         nullif(t - p_t, 0) AS gap
  FROM lag1),
spd AS (
  SELECT *, sqrt(vx * vx + vy * vy) AS norm, dist / gap AS speed FROM vec),
lag2 AS (
  SELECT *, lag(vx) OVER w AS p_vx, lag(vy) OVER w AS p_vy, lag(norm) OVER w AS p_norm,
         lag(speed) OVER w AS p_speed
  FROM spd WINDOW w AS (PARTITION BY session_id, window_idx, role ORDER BY t, seq)),
cut AS (
  SELECT session_id, window_idx, quantile_cont(norm, 0.75) AS fast_cut FROM lag2 GROUP BY 1, 2),
marks AS (
  SELECT l.*, norm > fast_cut AS fast,
    CASE WHEN norm > 1e-6 AND p_norm > 1e-6 THEN
      acos(greatest(-1.0, least(1.0, (vx * p_vx + vy * p_vy) / (norm * p_norm + 1e-12)))) END AS angle,
    (CASE WHEN sign(vx) * sign(p_vx) < 0 THEN 1 ELSE 0 END)
      + (CASE WHEN sign(vy) * sign(p_vy) < 0 THEN 1 ELSE 0 END) AS flips,
    CASE WHEN role = 'move' THEN (speed - p_speed) / gap END AS accel
  FROM lag2 l JOIN cut c USING (session_id, window_idx)),
moves AS (
  SELECT session_id, window_idx, max(w_ms) AS w_ms, count(*) AS n_move,
    avg(speed) AS speed_mean, stddev_samp(speed) AS speed_std,
    quantile_cont(speed, 0.5) AS speed_p50, quantile_cont(speed, 0.9) AS speed_p90,
    quantile_cont(speed, 0.99) AS speed_p99,
    avg(accel) AS accel_mean, stddev_samp(accel) AS accel_std,
    sum(dist) AS dist, sum(norm) AS path,
    sqrt(pow(arg_max(x, (t, seq)) - arg_min(x, (t, seq)), 2)
         + pow(arg_max(y, (t, seq)) - arg_min(y, (t, seq)), 2)) AS reach,
    avg(angle) AS mouse_curvature_mean, stddev_pop(angle) AS mouse_curvature_std,
    sum(norm) FILTER (fast) AS fast_norm,
    sqrt(pow(sum(vx) FILTER (fast), 2) + pow(sum(vy) FILTER (fast), 2)) AS fast_reach,
    sum(flips)::BIGINT AS flips
  FROM marks WHERE role = 'move' GROUP BY 1, 2),
clicks AS (
  SELECT session_id, window_idx, avg(t - p_t) AS click_interval_mean,
    stddev_samp(t - p_t) AS click_interval_std, avg(t - last_move_t) AS click_reaction_mean,
    quantile_cont(t - last_move_t, 0.05) AS click_reaction_p5,
    avg(sqrt(pow(x - p_x, 2) + pow(y - p_y, 2))) AS inter_click_movement
  FROM lag1 WHERE role = 'click' GROUP BY 1, 2),
presses AS (
  SELECT session_id, window_idx, count(*) AS n_press, avg(t - p_t) AS iki_mean,
    stddev_samp(t - p_t) AS iki_std, stddev_pop(t - p_t) AS iki_pop
  FROM lag1 WHERE role = 'press' GROUP BY 1, 2),
holds AS (
  SELECT p.session_id, p.window_idx, avg(h) AS hold_mean, stddev_samp(h) AS hold_std
  FROM (SELECT p.session_id, p.window_idx, q.t - p.t AS h
        FROM (SELECT * FROM win WHERE event_type = 'key_press') p
        ASOF JOIN (SELECT * FROM win WHERE event_type = 'key_release') q
          ON p.session_id = q.session_id AND p.window_idx = q.window_idx AND p.key = q.key AND p.t <= q.t) p
  WHERE h > 0 GROUP BY 1, 2),
rhythm AS (
  SELECT session_id, window_idx, var_samp(g) AS wasd_rhythm FROM (
    SELECT session_id, window_idx, t - lag(t) OVER (PARTITION BY session_id, window_idx ORDER BY t, seq) AS g
    FROM win WHERE event_type = 'key_press' AND lower(key) IN ('w','a','s','d')) GROUP BY 1, 2),
totals AS (
  SELECT session_id, window_idx, max(w_ms) AS w_ms, count(*) AS n,
    count(*) FILTER (event_type LIKE 'mouse%') AS n_mouse,
    count(*) FILTER (event_type IN ('key_press','key_release')) AS n_key,
    count(DISTINCT least(floor((t - w_start) / {BUCKET}), greatest(1, round_even(w_ms / {BUCKET}, 0)) - 1))
      / greatest(1, round_even(max(w_ms) / {BUCKET}, 0)) AS active_time_pct,
    count(*) FILTER (event_type = 'mouse_scroll') AS scroll_count,
    count(*) FILTER (event_type = 'mouse_scroll' AND dy > 0) AS n_down
  FROM win GROUP BY 1, 2),
feat AS (
  SELECT t.session_id, t.window_idx, t.n, t.w_ms,
    s.player, s.game, s.activity, s.is_cheat_session, s.sensitivity, s.dpi, s.recorded_us, s.duration_ms,
    speed_mean / nf AS speed_mean, speed_std / nf AS speed_std, speed_p50 / nf AS speed_p50,
    speed_p90 / nf AS speed_p90, speed_p99 / nf AS speed_p99, accel_mean / nf AS accel_mean,
    accel_std / nf AS accel_std,
    CASE WHEN n_move >= 2 THEN dist / greatest(reach, 1.0) END AS jitter,
    click_interval_mean, click_interval_std,
    CASE WHEN n_move >= 3 THEN mouse_curvature_mean END AS mouse_curvature_mean,
    CASE WHEN n_move >= 3 THEN mouse_curvature_std END AS mouse_curvature_std,
    CASE WHEN n_move >= 3 AND path > 1e-6 THEN reach / path END AS path_efficiency,
    CASE WHEN n_move >= 5 AND fast_norm > 1e-6 THEN fast_reach / fast_norm END AS fast_segment_straightness,
    CASE WHEN n_move >= 3 THEN flips / (t.w_ms / 1000.0::DOUBLE) * rn END AS direction_changes_per_sec,
    hold_mean, hold_std, iki_mean, iki_std,
    coalesce(n_press, 0) / (t.w_ms / 1000.0::DOUBLE) AS burst_rate, wasd_rhythm,
    click_reaction_mean, click_reaction_p5, inter_click_movement,
    CASE WHEN n_press >= 3 AND iki_mean > 1e-6 THEN iki_pop / iki_mean END AS keystroke_periodicity,
    n / (t.w_ms / 1000.0::DOUBLE) * rn AS event_rate,
    n_mouse / (n_key + 1e-9::DOUBLE) * rn AS mouse_key_ratio,
    active_time_pct, scroll_count,
    CASE WHEN scroll_count > 0 THEN n_down / scroll_count::DOUBLE END AS scroll_direction_ratio
  FROM totals t
  JOIN (SELECT *, sensitivity * dpi / 800.0::DOUBLE AS nf,
               CASE WHEN polling_rate > 0 THEN 1000.0::DOUBLE / polling_rate ELSE 1.0::DOUBLE END AS rn FROM sess) s
    USING (session_id)
  LEFT JOIN moves m USING (session_id, window_idx) LEFT JOIN clicks c USING (session_id, window_idx)
  LEFT JOIN presses k USING (session_id, window_idx) LEFT JOIN holds h USING (session_id, window_idx)
  LEFT JOIN rhythm y USING (session_id, window_idx))
"""


def events_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE} {body}"


def sessions_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE}, {SESSIONS_CTE} {body}"


def windows_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE}, {SESSIONS_CTE}, {WINDOWED_CTE} {body}"


def features_sql(body: str) -> str:
    return f"WITH {EVENTS_CTE}, {SESSIONS_CTE}, {WINDOWED_CTE}, {FEATURES_CTE} {body}"


def with_sql(base: str, ctes: str, body: str) -> str:
    """Extend one of the shared prefixes by further CTEs."""
    prefix = {"events": events_sql, "sessions": sessions_sql,
              "windows": windows_sql, "features": features_sql}[base]("")
    return f"{prefix}, {ctes} {body}"
