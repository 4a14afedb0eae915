"""Streaming queries: the views or ``events`` replayed through Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.exprs import epoch_micros, rounded
from ..session import shared_dir
from ..sources.tables import DAY_MS, VIEW_WINDOW_MS, telemetry
from ..streaming import messages, online, scoring
from .evaluation_queries import sc_sql, scores, table_slices
from .registry import query, r
from .views import events_sql, features_sql, with_sql
from .window_queries import _FEATURE_LIST, rounded_features


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"


def replay(spark, sf) -> str:
    """Write the message table, stream it, return the output folder."""
    out = _folder(spark)
    tele = telemetry(spark, sf)
    online.replay_messages(tele.events, tele.sessions).repartition("session_id").write.parquet(f"{out}/messages")
    online.run_online(online.stream_table(spark, f"{out}/messages"), out, f"{out}/state",
                      VIEW_WINDOW_MS, 16, DAY_MS)
    return out


@query("streaming_window_features", features_sql(f"SELECT session_id, window_idx, {_FEATURE_LIST} FROM feat WHERE n >= 2"))
def streaming_window_features(spark, sf):
    """Windows closed online equal the batch windows that hold two events or more."""
    df = spark.read.parquet(f"{replay(spark, sf)}/features").withColumn("window_idx", F.col("window_idx").cast("int"))
    return rounded_features(df.select("session_id", "window_idx", *FEATURES))


@query("streaming_chunks", events_sql(f"""
  SELECT session_id, (seq // 16)::BIGINT AS chunk_idx, count(*) AS n, {r('min(t)', 't_first', 3)}, {r('max(t)', 't_last', 3)}
  FROM ev GROUP BY 1, 2 HAVING count(*) = 16"""))
def streaming_chunks(spark, sf):
    units = spark.read.parquet(f"{replay(spark, sf)}/units").filter("kind = 'chunk'")
    return rounded(units.groupBy("session_id", F.col("unit").alias("chunk_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last")), 3)


@query("streaming_late_events", events_sql("""
  SELECT session_id, sum((value < mx)::INT)::BIGINT AS late, sum((mx IS NULL OR value >= mx)::INT)::BIGINT AS kept FROM (
    SELECT *, max(value) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM ev) GROUP BY 1"""))
def streaming_late_events(spark, sf):
    """With ``value`` as the clock most events arrive late; they are dropped and counted."""
    out = _folder(spark)
    tele = telemetry(spark, sf)
    shuffled = tele.events.withColumn("t", F.col("value"))
    online.replay_messages(shuffled, tele.sessions).repartition("session_id").write.parquet(f"{out}/messages")
    online.run_online(online.stream_table(spark, f"{out}/messages"), out, f"{out}/state", 1000.0, 16)
    units = spark.read.parquet(f"{out}/units").filter("kind = 'end'")
    return units.select("session_id", "late", F.col("unit").alias("kept"))


# Later than every event, so that the watermark passes all of them; its own group never closes.
END_OF_REPLAY = "9999-12-01 00:00:00"


def _timed(spark, sf, markers):
    """Events, and what ``markers`` will hold, as one stream."""
    e = online.stream_table(spark, f"{sf}/events.parque[t]")  # a pattern takes one file as well as a folder of parts
    told = e.select("user_id", "event_type", F.timestamp_micros(epoch_micros(F.col("ts"))).alias("ts"))
    return told.unionByName(spark.readStream.schema(told.schema).parquet(markers))


def _closed(spark, sf, counts):
    """Every group of a replayed table once, in append mode.

    The watermark closes groups while the table streams in; a marker at the end of the replay closes the others.
    """
    out = _folder(spark)
    markers = f"{out}/markers"

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/result/batch_id={batch_id}")

    def run():
        counts(_timed(spark, sf, markers)).writeStream.outputMode("append").foreachBatch(sink).option(
            "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    last = spark.range(1).select(
        F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"),
        F.lit(END_OF_REPLAY).cast("timestamp").alias("ts"))
    last.limit(0).write.parquet(markers)
    run()
    last.write.mode("append").parquet(markers)
    run()
    return spark.read.parquet(f"{out}/result").drop("batch_id")


@query("streaming_tumbling_counts", """
  SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streaming_tumbling_counts(spark, sf):
    """Daily counts of all days."""
    res = _closed(spark, sf, lambda e: online.tumbling_counts(e, "1 day", "1 day"))
    return res.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query("streaming_session_counts", """
  SELECT user_id, min(us) AS start_us, count(*) AS n FROM (
    SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS nw FROM events))
  GROUP BY user_id, g""")
def streaming_session_counts(spark, sf):
    """Counts of all idle-gap sessions."""
    res = _closed(spark, sf, lambda e: online.idle_session_counts(e, "12 hours", "1 day"))
    return res.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("running_session_updates", sc_sql(f"""
  SELECT session_id, "at", detector, {r('top', 'top')}, {r('1 / (1 + exp(-(ln(0.05::DOUBLE / 0.95) + sum(g) OVER (PARTITION BY session_id ORDER BY "at", detector ROWS UNBOUNDED PRECEDING))))', 'risk')} FROM (
    SELECT *, greatest(p, bf) AS top, ln(greatest(p, coalesce(bf, p)) / (1 - greatest(p, coalesce(bf, p)))) - coalesce(ln(bf / (1 - bf)), 0) AS g FROM (
      SELECT *, max(p) OVER (PARTITION BY session_id, detector ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM (
        SELECT 's' || (doc_id % 50) AS session_id, doc_id AS "at", detector, least(0.99, greatest(0.01, score)) AS p FROM sc)))"""))
def running_session_updates(spark, sf):
    s = scores(spark, sf).select(
        F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session_id"), F.col("doc_id").alias("at"),
        F.when(F.col("detector") == "hash", "chunk").otherwise("window").alias("triggered_by"), "detector",
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("score"))).alias("p"))
    return rounded(online.running_updates(s, table_slices(spark, sf, "labels")).drop("triggered_by"))


SCORED_CALIBRATION = {"speed": (0.01, -2.0), "rate": (0.5, -1.0), "pace": (0.05, -1.0)}
# Settings told in mid-session, after the 20th and 40th event: one field of the pair changes nothing, both do.
MIDWAY = [(39, 9.0, None, 500.0), (79, 1.5, 1600.0, None)]
SCORED_LEN = 16


def window_scores(features):
    """Mean pointer speed and events a day."""
    return scoring.long_scores(features, {"speed": F.coalesce("speed_mean", F.lit(0.0)), "rate": F.col("event_rate") * 86400.0})


def chunk_pace(chunks):
    """Days that a chunk took."""
    spans = chunks.groupBy("session_id", "unit", "trigger_seq").agg(((F.max("t") - F.min("t")) / DAY_MS).alias("days"))
    return scoring.long_scores(spans, {"pace": F.col("days")})


def scored_messages(tele):
    """Recorded sessions with room between their events, and settings in mid-session."""
    spaced = online.replay_messages(tele.events.withColumn("seq", F.col("seq") * 2), tele.sessions)
    midway = F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("seq"), *[
        F.lit(v).cast("double").alias(c) for c, v in zip(("sensitivity", "dpi", "polling_rate"), rest)]) for s, *rest in MIDWAY]))
    told = tele.sessions.select("session_id", midway).withColumn("type", F.lit("__session__"))
    return spaced.unionByName(told, allowMissingColumns=True)


def replay_scored(spark, sf, cuts=(30, 90)):
    """Snapshots of all sessions, streamed in parts that end at the given sequence numbers."""
    out = _folder(spark)
    told = scored_messages(telemetry(spark, sf))
    for low, high in zip((None, *cuts), (*cuts, None)):
        part = told
        if low is not None:
            part = part.where(F.col("seq") >= low)
        if high is not None:
            part = part.where(F.col("seq") < high)
        part.repartition("session_id").write.mode("append").parquet(f"{out}/messages")
    detectors = scoring.Detectors(window_scores, chunk_pace, scoring.platt_calibration(SCORED_CALIBRATION), ("speed", "rate"))
    per_trigger = spark.read.parquet(f"{out}/messages").select(F.input_file_name()).distinct().count() // (len(cuts) + 1)
    stream = online.stream_table(spark, f"{out}/messages", per_trigger=max(per_trigger, 1))
    return scoring.run_scoring(stream, detectors, out, VIEW_WINDOW_MS, SCORED_LEN, DAY_MS)


_PLATT = " ".join(f"WHEN '{n}' THEN least(0.999, greatest(0.001, 1 / (1 + exp(-({a}::DOUBLE * value + {b})))))"
                  for n, (a, b) in SCORED_CALIBRATION.items())


@query("streaming_scored_updates", with_sql("features", f"""
placed AS (
  SELECT session_id, seq, t, w, lag(w) OVER (PARTITION BY session_id ORDER BY seq) AS was, (seq + 1) % {SCORED_LEN} = 0 AS whole,
         last_seq, last_t FROM (
    SELECT session_id, seq, t, floor(t / {VIEW_WINDOW_MS})::INT AS w, max(seq) OVER (PARTITION BY session_id) AS last_seq,
           max(t) OVER (PARTITION BY session_id) AS last_t FROM ev)),
trig AS (
  SELECT session_id, 2 * seq AS s, t, seq + 1 AS n_events, CASE WHEN whole THEN 'chunk' ELSE 'window' END AS triggered_by
  FROM placed WHERE w > was OR whole
  UNION ALL SELECT DISTINCT session_id, 2 * last_seq + 1, last_t, last_seq + 1, 'finalize' FROM placed),
closing AS (
  SELECT session_id, was AS w, 2 * seq AS s FROM placed WHERE w > was
  UNION ALL SELECT session_id, max(w), 2 * max(seq) + 1 FROM placed GROUP BY 1),
wsc AS (
  SELECT f.session_id, c.s, coalesce(speed_mean * (sensitivity * dpi / 800.0::DOUBLE)
           / CASE WHEN c.s > 79 OR c.s % 2 = 1 THEN 3.0::DOUBLE ELSE sensitivity * dpi / 800.0::DOUBLE END, 0) AS speed,
         f.n / (f.w_ms / 1000.0::DOUBLE) * 86400.0::DOUBLE * CASE WHEN c.s > 39 OR c.s % 2 = 1 THEN 2.0::DOUBLE ELSE
           (SELECT CASE WHEN polling_rate > 0 THEN 1000.0::DOUBLE / polling_rate ELSE 1.0::DOUBLE END FROM sess WHERE sess.session_id = f.session_id) END AS rate
  FROM feat f JOIN closing c ON c.session_id = f.session_id AND c.w = f.window_idx WHERE n >= 2),
csc AS (
  SELECT session_id, 2 * max(seq) AS s, (max(t) - min(t)) / {DAY_MS} AS pace FROM ev
  GROUP BY session_id, seq // {SCORED_LEN} HAVING count(*) = {SCORED_LEN}),
w AS (
  SELECT t.session_id, t.s, count(c.s) AS n_windows, max(speed) AS speed, max(rate) AS rate
  FROM trig t LEFT JOIN wsc c ON c.session_id = t.session_id AND c.s <= t.s GROUP BY 1, 2),
c AS (
  SELECT t.session_id, t.s, count(c.s) AS n_chunks, quantile_cont(pace, 0.95) AS pace, arg_max(pace, c.s) AS latest
  FROM trig t LEFT JOIN csc c ON c.session_id = t.session_id AND c.s <= t.s GROUP BY 1, 2),
vals AS (
  SELECT session_id, s, 'speed' AS detector, speed AS value, NULL::DOUBLE AS latest FROM w WHERE speed IS NOT NULL
  UNION ALL SELECT session_id, s, 'rate', rate, NULL FROM w WHERE rate IS NOT NULL
  UNION ALL SELECT session_id, s, 'pace', pace, latest FROM c WHERE pace IS NOT NULL),
gains AS (SELECT *, ln(p / (1 - p)) AS gain FROM (SELECT *, CASE detector {_PLATT} END AS p FROM vals)),
risks AS (SELECT session_id, s, sum(gain) AS total FROM gains GROUP BY 1, 2)""", f"""
SELECT t.session_id, t.s AS seq, t.n_events, n_windows, n_chunks, t.triggered_by, detector, {r('value', 'value')}, {r('gain', 'log_odds')},
       {r('g.latest', 'latest')}, {r('1 / (1 + exp(-(ln(0.05::DOUBLE / 0.95) + coalesce(total, 0))))', 'session_risk')}
FROM trig t JOIN w USING (session_id, s) JOIN c USING (session_id, s) LEFT JOIN gains g USING (session_id, s) LEFT JOIN risks USING (session_id, s)"""))
def streaming_scored_updates(spark, sf):
    """Every snapshot of every session, a row per detector that has scored."""
    found = replay_scored(spark, sf)
    fired = found.select("*", F.explode_outer(F.map_keys("detector_logits")).alias("detector"))
    return rounded(fired.select(
        "session_id", "seq", "n_events", "n_windows", "n_chunks", "triggered_by", "detector",
        F.col("per_detector")[F.col("detector")].alias("value"), F.col("detector_logits")[F.col("detector")].alias("log_odds"),
        F.col("chunk_scores")[F.col("detector")].alias("latest"), "session_risk"))


IDLE_HOURS = 12


@query("streaming_idle_sessions", with_sql("features", """
seen AS (SELECT session_id, max(us) // 1000 AS last_ms, count(*) AS n_events FROM ev GROUP BY 1)""", f"""
SELECT session_id, n_events, count(f.n) AS n_windows, 0::BIGINT AS refused
FROM seen LEFT JOIN (SELECT * FROM feat WHERE n >= 2) f USING (session_id)
WHERE last_ms + {IDLE_HOURS} * 3600000 <= (SELECT max(last_ms) FROM seen) GROUP BY 1, 2"""))
def streaming_idle_sessions(spark, sf):
    """Sessions that end by the clock alone: the trailing window is closed and the state removed."""
    out = _folder(spark)
    tele = telemetry(spark, sf)
    told = online.replay_messages(tele.events, tele.sessions).where("type <> '__end__'").join(
        tele.events.select("session_id", "seq", F.timestamp_millis(F.floor(F.col("us") / 1000)).alias("received")), ["session_id", "seq"], "left")
    first = tele.events.groupBy("session_id").agg(F.timestamp_millis(F.floor(F.min("us") / 1000)).alias("opened"))
    told = told.join(first, "session_id").withColumn("received", F.coalesce("received", "opened")).drop("opened")
    told.repartition("session_id").write.parquet(f"{out}/messages")
    online.run_online(online.stream_table(spark, f"{out}/messages"), out, f"{out}/state", VIEW_WINDOW_MS, SCORED_LEN, DAY_MS,
                      idle=f"{IDLE_HOURS} hours")
    units = spark.read.parquet(f"{out}/units")
    ended = units.where("kind = 'end'").select("session_id", F.col("unit").alias("n_events"))
    windows = units.where("kind = 'window'").groupBy("session_id").agg(F.countDistinct("unit").alias("n_windows"))
    closed = units.where("kind = 'closed'").select("session_id", F.col("unit").alias("refused"))
    return ended.join(closed, "session_id").join(windows, "session_id", "left").select(
        "session_id", "n_events", F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"), "refused")


@query("streaming_json_messages", events_sql("""
  SELECT coalesce(reason, 'good') AS outcome, type, count(*) AS n, count(DISTINCT session_id) AS sessions, sum(seq)::BIGINT AS seqs FROM (
    SELECT reason, CASE WHEN reason IS NULL THEN event_type END AS type, CASE WHEN reason IS NULL THEN session_id END AS session_id,
           CASE WHEN reason IS NULL THEN seq END AS seq FROM (
      SELECT *, CASE WHEN us % 11 = 0 THEN 'json' WHEN us % 11 = 1 THEN 'object' WHEN us % 11 = 2 THEN 'session'
                     WHEN us % 11 = 3 THEN 'field:t' WHEN us % 11 = 4 THEN 'order' END AS reason FROM ev)) GROUP BY 1, 2"""))
def streaming_json_messages(spark, sf):
    """Events as JSON lines, some of them damaged, split by the stream into good and bad ones."""
    out = _folder(spark)
    kind = F.col("us") % 11
    ev = telemetry(spark, sf).events
    whole = F.to_json(F.struct(
        F.when(kind != 2, F.col("session_id")).alias("session_id"), F.when(kind != 4, F.col("seq")).alias("seq"),
        F.col("event_type").alias("type"), F.when(kind != 3, F.col("t")).alias("t"), F.when(kind == 3, F.lit("soon")).alias("t_text"),
        "x", "y", "dx", "dy", "pressed", "key"))
    body = (F.when(kind == 0, F.substring(whole, 1, 20)).when(kind == 1, F.concat(F.lit("["), whole, F.lit("]")))
            .otherwise(F.replace(whole, F.lit('"t_text"'), F.lit('"t"'))))
    ev.select(body.alias("value")).write.text(f"{out}/lines")
    messages.split_messages(spark.readStream.text(f"{out}/lines"), f"{out}/split", f"{out}/state")
    found = spark.read.parquet(f"{out}/split")
    return found.groupBy(F.coalesce("reason", F.lit("good")).alias("outcome"), "type").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.sum("seq").alias("seqs"))
