"""Cheat spans, toggles, and labels for sessions and chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered
from .joins import interval_join

# ---- fixed values: recording variants and difficulty names ----
VARIANT_SUFFIXES = ["legit", "aimbot_obvious", "aimbot_medium", "aimbot_soft", "triggerbot", "macro"]
DIFFICULTIES = ["soft", "medium", "obvious"]


def toggle_spans(
    events: DataFrame, toggle_keys: Mapping[str, str], session_end: DataFrame | None = None, slices: int = 1
) -> DataFrame:
    """Key presses that switch a cheat on and off -> (session_id, start_ms, end_ms, cheat).

    Odd presses start a span, the next press ends it, an open span runs to the session
    end (``session_end``: session_id, end_ms; default the last event).
    """
    names = F.create_map(*[F.lit(x) for pair in toggle_keys.items() for x in pair])
    presses = (
        events.filter((F.col("event_type") == "key_press") & F.col("key").isin(list(toggle_keys)))
        .select("session_id", names[F.col("key")].alias("cheat"), "t", "seq"))
    if session_end is None:
        session_end = events.groupBy("session_id").agg(F.max("t").alias("end_ms"))
    keys = ("session_id", "cheat")
    counted = Ordered(keys, ("t", "seq"), slices).apply(presses, position="_at")
    ended = Ordered(keys, ("t", "seq"), slices, reverse=True).apply(counted, lag={"_next": "t"})
    return (
        ended.filter(F.col("_at") % 2 == 0)
        .join(session_end.select("session_id", F.col("end_ms").alias("_end")), "session_id", "left")
        .select("session_id", F.col("t").alias("start_ms"),
                F.coalesce("_next", "_end").alias("end_ms"), "cheat")
        .filter(F.col("end_ms") > F.col("start_ms")))


def dominant_label(spans: DataFrame) -> DataFrame:
    """Cheat with the largest active time per session (ties: first name)."""
    active = spans.groupBy("session_id", "cheat").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("active_ms"))
    best = F.min_by("cheat", F.struct(-F.col("active_ms"), F.col("cheat")))
    return active.groupBy("session_id").agg(best.alias("label"), F.max("active_ms").alias("active_ms"))


def session_labels(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """legit / the only cheat / mixed, with the sorted list of cheats."""
    per = spans.groupBy("session_id").agg(F.array_sort(F.collect_set("cheat")).alias("cheats"))
    joined = sessions.select("session_id").join(per, "session_id", "left")
    cheats = F.coalesce("cheats", F.array().cast("array<string>"))
    label = F.when(F.size("cheats") == 0, "legit").when(F.size("cheats") == 1, F.get("cheats", F.lit(0))).otherwise("mixed")
    return joined.withColumn("cheats", cheats).withColumn("label", label)


def resolve_spans(sessions: DataFrame, drop_accidental: bool = False) -> DataFrame:
    """Typed spans where a session has any, else its untyped spans under its label.

    Input columns: ``cheat_segments_typed`` (array of structs), ``cheat_segments``
    (array of [start, end]), ``cheat_label``.
    """
    has_typed = F.coalesce(F.size("cheat_segments_typed"), F.lit(0)) > 0
    typed = sessions.filter(has_typed).select(
        "session_id", F.explode("cheat_segments_typed").alias("s"))
    if drop_accidental:
        typed = typed.filter(~F.coalesce("s.accidental", F.lit(False)))
    typed = typed.select("session_id", "s.start_ms", "s.end_ms", "s.cheat")
    label = F.coalesce("cheat_label", F.lit("legit"))
    untyped = sessions.filter(~has_typed & (label != "legit")).select(
        "session_id", F.explode("cheat_segments").alias("s"), label.alias("cheat"))
    return typed.unionByName(untyped.select(
        "session_id", F.get("s", F.lit(0)).alias("start_ms"), F.get("s", F.lit(1)).alias("end_ms"), "cheat"))


def chunk_labels(members: DataFrame, spans: DataFrame, slices: int = 1) -> DataFrame:
    """Majority cheat per chunk by number of distinct events inside its spans.

    ``members``: (session_id, chunk_idx, seq, t).  Ties go to the first name; chunks
    without overlap get ''.
    """
    inside = interval_join(members, spans, slices).groupBy("session_id", "chunk_idx", "cheat").agg(
        F.count_distinct("seq").alias("hits"))
    best = inside.groupBy("session_id", "chunk_idx").agg(
        F.min_by("cheat", F.struct(-F.col("hits"), F.col("cheat"))).alias("label"),
        F.max("hits").alias("hits"))
    chunks = members.select("session_id", "chunk_idx").distinct()
    return chunks.join(best, ["session_id", "chunk_idx"], "left").select(
        "session_id", "chunk_idx", F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("hits", F.lit(0)).alias("hits"))


def chunk_flags(members: DataFrame, spans: DataFrame, slices: int = 1) -> DataFrame:
    """Whether any event of a chunk lies inside a span."""
    touched = interval_join(members, spans, slices).select("session_id", "chunk_idx").distinct().withColumn("_hit", F.lit(True))
    chunks = members.select("session_id", "chunk_idx").distinct()
    return chunks.join(touched, ["session_id", "chunk_idx"], "left").select(
        "session_id", "chunk_idx", F.coalesce("_hit", F.lit(False)).alias("contains_cheat"))


def difficulty(field: Column, file_name: Column) -> Column:
    """Declared difficulty, else the file-name suffix, else NULL."""
    suffix = F.regexp_extract(F.lower(file_name), rf"_({'|'.join(DIFFICULTIES)})\.json$", 1)
    return F.coalesce(F.nullif(F.lower(field), F.lit("")), F.nullif(suffix, F.lit("")))


def base_recording(file_name: Column) -> Column:
    """Recording a variant file was derived from."""
    stem = F.regexp_replace(file_name, r"\.json$", "")
    return F.regexp_replace(stem, f"_({'|'.join(VARIANT_SUFFIXES)})$", "")


def pooled_by_difficulty(scored: DataFrame) -> DataFrame:
    """Each cheat row once under its difficulty and once under 'all'."""
    pools = F.array_compact(F.array(F.col("difficulty"), F.lit("all")))
    return scored.withColumn("pool", F.explode(pools))
