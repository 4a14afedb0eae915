"""Readers and writers: session JSON, pointer CSV corpora, Parquet tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MIN_EVENTS
from ..operators import quality as q

EVENT_TEXT_FIELDS = (
    "t STRING, type STRING, x STRING, y STRING, dx STRING, dy STRING, "
    "button STRING, pressed STRING, key STRING")
SESSION_FIELDS = (
    "session_id STRING, player STRING, game STRING, activity STRING, polling_rate INT, "
    "resolution STRING, grip_style STRING, dominant_hand STRING, warmup BOOLEAN, "
    "sensitivity DOUBLE, dpi INT, recorded_at STRING, duration_ms DOUBLE, event_count INT, "
    f"events ARRAY<STRUCT<{EVENT_TEXT_FIELDS.replace(' STRING', ': STRING')}>>, "
    "cheat_label STRING, cheat_labels ARRAY<STRING>, difficulty STRING, "
    "cheat_segments ARRAY<ARRAY<DOUBLE>>, "
    "cheat_segments_typed ARRAY<STRUCT<start_ms: DOUBLE, end_ms: DOUBLE, cheat: STRING, accidental: BOOLEAN>>")


def read_documents(spark: SparkSession, folder: str, strict_types: bool = True, pattern: str = "*.json") -> DataFrame:
    """Every file of a folder that matches ``pattern``, with its error list; one row per file."""
    text = spark.read.text(f"{folder}/{pattern}", wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))
    doc = text.withColumn("doc", F.try_parse_json("body"))
    return doc.withColumn("errors", q.document_errors(F.col("doc"), strict_types=strict_types)).withColumn(
        "s", F.from_json("body", SESSION_FIELDS)).drop("doc")


def read_sessions(spark: SparkSession, folder: str, strict_types: bool = True,
                  pattern: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, events, rejected) of a recording folder.

    A document without a single usable event is rejected as well.
    """
    docs = read_documents(spark, folder, strict_types, pattern)
    usable = F.exists("s.events", lambda e: e["type"].isin(q.EVENT_KINDS))
    empty = (F.size("errors") == 0) & ~F.coalesce(usable, F.lit(False))
    docs = docs.withColumn("errors", F.when(empty, F.array(F.lit("events:unusable"))).otherwise(F.col("errors")))
    good, bad = q.quarantine(docs)
    typed = F.size("s.cheat_segments_typed")
    untyped = F.size("s.cheat_segments")
    plain = [f for f in ("session_id", "player", "game", "activity", "polling_rate", "resolution", "grip_style",
                         "dominant_hand", "warmup", "sensitivity", "dpi", "duration_ms", "event_count")]
    sessions = q.normalise_metadata(good.select(
        *[F.col(f"s.{c}").alias(c) for c in plain], "source_file",
        q.parse_utc(F.col("s.recorded_at")).alias("recorded_at"),
        q.is_cheat(typed, untyped, F.col("s.cheat_label")).alias("is_cheat_session"),
        *[F.col(f"s.{c}").alias(c) for c in ("cheat_label", "difficulty", "cheat_segments", "cheat_segments_typed")]))
    exploded = good.select(F.col("s.session_id").alias("session_id"), F.posexplode("s.events").alias("pos", "e"))
    events = q.coerce_events(exploded.select("session_id", F.col("pos").cast("long").alias("seq"), "e.*"))
    return sessions, events, bad.select("source_file", "errors")


def write_tables(sessions: DataFrame, events: DataFrame, folder: str) -> None:
    """Columnar tables; events of a session stay together and in time order.

    Hashing (session, 16-minute slice) keeps a long recording from filling one task.
    """
    sessions.write.mode("overwrite").parquet(f"{folder}/sessions")
    part = F.floor(F.col("t") / 1_000_000.0)
    (events.withColumn("_part", part).repartition("session_id", "_part")
     .sortWithinPartitions("session_id", "t", "seq").drop("_part")
     .write.mode("overwrite").parquet(f"{folder}/events"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_documents(sessions: DataFrame, events: DataFrame, folder: str) -> None:
    """One JSON document per session under ``folder/file=<session_id>``, written event by event.

    A document is a run of lines in one file: an opening with the metadata, a line per event in order, a
    closing. Lines are sorted once by (session, place) and streamed into the file by its task, so that no
    session is ever held as a whole; Spark's committer leaves no file of a failed attempt. A session
    without events has an empty list.
    """
    fields = ["t", "x", "y", "dx", "dy", "button", "pressed", "key"]
    keep = [c for c in sessions.columns if c not in ("source_file", "is_cheat_session")]
    docs = sessions.select(*keep)
    if "recorded_at" in keep:
        docs = docs.withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    opening = F.regexp_replace(F.to_json(F.struct(*docs.columns)), r"\}$", ',"events":[')
    none = F.lit(0).cast("long")
    lines = docs.select(F.col("session_id").alias("file"), F.lit(0).alias("_rank"), none.alias("_seq"), opening.alias("value"))
    lines = lines.unionByName(docs.select(F.col("session_id").alias("file"), F.lit(2).alias("_rank"), none.alias("_seq"), F.lit("]}").alias("value")))
    known = events.join(docs.select("session_id"), "session_id", "left_semi")
    lines = lines.unionByName(known.select(
        F.col("session_id").alias("file"), F.lit(1).alias("_rank"), F.col("seq").cast("long").alias("_seq"),
        F.to_json(F.struct(F.col("event_type").alias("type"), *fields)).alias("value")))
    place = Window.partitionBy("file").orderBy("_rank", "_seq")
    comma = F.when((F.col("_rank") == 1) & (F.lag("_rank").over(place) == 1), ",").otherwise("")
    lines.withColumn("value", F.concat(comma, "value")).select("file", "value").write.mode("overwrite").partitionBy(
        "file").text(folder)


def folder_label(path: Column) -> Column:
    """0 / 1 from the corpus folder name."""
    return F.when(path.contains("no_cheater_present"), 0).when(path.contains("with_cheater_present"), 1)


_CSV_A = "`record timestamp` DOUBLE, `client timestamp` DOUBLE, button STRING, state STRING, x INT, y INT"
_CSV_B = "`client timestamp` DOUBLE, button STRING, state STRING, x INT, y INT"


def _csv(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    raw = spark.read.option("header", True).schema(schema).csv(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(
        "*", F.col("_metadata.file_name").alias("file"), F.element_at(parts, -2).alias("user"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("seq"))


def read_pointer_corpus_a(spark: SparkSession, pattern: str, min_rows: int = MIN_EVENTS) -> DataFrame:
    """CSV with two clocks in seconds, users from the folder; files under the volume rule's length are dropped."""
    raw = _csv(spark, pattern, _CSV_A)
    sizes = raw.groupBy("file", "user").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    rows = raw.join(sizes, ["file", "user"], "left_semi").select(
        F.concat_ws("/", "user", "file").alias("session_id"), "user", "file", "seq",
        (F.col("client timestamp") * 1000.0).alias("t"), "button", "state", "x", "y")
    return q.drop_sentinels(rows)


def read_pointer_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("filename STRING, is_illegal INT").csv(path)


def read_pointer_corpus_b(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV with a millisecond clock; every file starts at zero, protocol from its name."""
    raw = _csv(spark, pattern, _CSV_B)
    start = raw.groupBy("file", "user").agg(F.min("client timestamp").alias("_t0"))
    return raw.join(start, ["file", "user"]).select(
        F.concat_ws("/", "user", "file").alias("session_id"), "user", "file", "seq",
        (F.col("client timestamp") - F.col("_t0")).alias("t"), "button", "state", "x", "y",
        F.regexp_extract("file", "(1min|3min)", 1).alias("protocol"))


def write_report_csv(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(folder)


def write_report_json(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)


MESSAGE_FIELDS = (
    "session_id STRING, seq BIGINT, type STRING, t DOUBLE, x INT, y INT, dx INT, dy INT, "
    "pressed BOOLEAN, key STRING, sensitivity DOUBLE, dpi DOUBLE, polling_rate DOUBLE")


def parse_messages(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, unreadable) from a text / Kafka-value stream of JSON messages."""
    parsed = raw.select(F.col(value).cast("string").alias("body")).withColumn("m", F.from_json("body", MESSAGE_FIELDS))
    ok = F.col("m.session_id").isNotNull() & F.col("m.type").isNotNull()
    return parsed.filter(ok).select("m.*"), parsed.filter(~ok | F.col("m").isNull()).select("body")
