"""Live session scores: detectors over complete units, running statistics per detector, risk per trigger.

Two streaming queries in a row.  The first closes windows and chunks (``online``), computes their
features and lets the detectors score them; all of that are DataFrame operations of a micro-batch.
The second keeps, per session and detector, the highest window score or a bounded sketch of chunk
scores (95th percentile), and gives a row per detector and trigger.  A snapshot per trigger follows
from these rows: running values, log-odds and the combined risk.  Detectors that have not scored yet
give no evidence.  The state of a session goes with its last trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import CHUNK_LEN, LOGIT_FLOOR, PRIOR_RISK, WINDOW_MS
from ..functions.exprs import logit, sigmoid
from ..operators.risk import apply_platt
from ..session import ship_package
from . import online, sketch

CHUNK_QUANTILE = 0.95
UPDATES = (
    "session_id STRING, seq BIGINT, t DOUBLE, n_events BIGINT, n_windows BIGINT, n_chunks BIGINT, triggered_by STRING, "
    "detector STRING, grain STRING, value DOUBLE, latest DOUBLE")
_UPDATE = [c.strip().split(" ")[0] for c in UPDATES.split(",")]
_KINDS = {c: np.int64 for c in ("seq", "n_events", "n_windows", "n_chunks")} | {c: float for c in ("t", "value", "latest")}
_TOLD = ["seq", "is_trigger", "unit", "detector", "grain", "score", "t", "n_events", "triggered_by"]
COUNTS_STATE = "n_windows BIGINT, n_chunks BIGINT, last_window BIGINT, last_chunk BIGINT"
DETECTOR_STATE = "grain STRING, top DOUBLE, latest DOUBLE, points ARRAY<DOUBLE>, weights ARRAY<DOUBLE>"


@dataclass(frozen=True)
class Detectors:
    """Scores of complete units and their calibration.

    ``windows`` gets window features, ``chunks`` the rows of chunks; both return (session_id, unit,
    trigger_seq, detector, score).  ``calibrate`` adds ``p`` to rows with (detector, score).
    """

    windows: Callable[[DataFrame], DataFrame]
    chunks: Callable[[DataFrame], DataFrame]
    calibrate: Callable[[DataFrame], DataFrame]
    window_names: Sequence[str] = field(default_factory=tuple)


def long_scores(units: DataFrame, scores: Mapping[str, Column], unit: str = "unit") -> DataFrame:
    """One row per unit and detector from a column per detector."""
    entries = F.array(*[F.struct(F.lit(n).alias("detector"), c.cast("double").alias("score")) for n, c in scores.items()])
    return units.select("session_id", F.col(unit).alias("unit"), "trigger_seq", F.inline(entries))


def platt_calibration(parameters: Mapping[str, tuple[float, float]]) -> Callable[[DataFrame], DataFrame]:
    """Logistic calibration with (slope, intercept) per detector; others get no probability."""
    def calibrate(rows: DataFrame) -> DataFrame:
        p = F.lit(None).cast("double")
        for name, (slope, intercept) in parameters.items():
            p = F.when(F.col("detector") == name, apply_platt(F.col("score"), slope, intercept)).otherwise(p)
        return rows.withColumn("p", p)
    return calibrate


def scored_units(units: DataFrame, features: DataFrame, detectors: Detectors) -> DataFrame:
    """Scores and triggers of a micro-batch in one shape."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        (detectors.windows(features), "window"), (detectors.chunks(units.filter("kind = 'chunk'")), "chunk")]
    rows = units.filter("kind = 'trigger'").select(
        "session_id", F.col("trigger_seq").alias("seq"), F.lit(1).alias("is_trigger"), none("long").alias("unit"),
        none("string").alias("grain"), none("string").alias("detector"), none("double").alias("score"), "t", "n_events",
        "triggered_by")
    for scores, grain in parts:
        rows = rows.unionByName(scores.select(
            "session_id", F.col("trigger_seq").alias("seq"), F.lit(0).alias("is_trigger"), F.col("unit").cast("long").alias("unit"),
            F.lit(grain).alias("grain"), "detector", "score", none("double").alias("t"), none("long").alias("n_events"),
            none("string").alias("triggered_by")))
    return rows


class RunningScores(StatefulProcessor):
    """A row per trigger and detector that has scored; one without detector where none has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", COUNTS_STATE)
        self.detectors = handle.getMapState("detectors", "detector STRING", DETECTOR_STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows), ignore_index=True)
        told = sorted(zip(*[frame[c].tolist() for c in _TOLD]), key=lambda r: (
            r[0], r[1], (pd.isna(r[2]), r[2]) if not r[1] else (True, 0), (r[3] is None, r[3] or "")))
        known = {k[0]: list(v) for k, v in self.detectors.iterator()}
        counts = list(self.counts.get() or (0, 0, -1, -1))
        values = {name: _value(s) for name, s in known.items()}
        changed, out, over = set(), [], False
        for seq, is_trigger, unit, detector, grain, score, t, n_events, triggered_by in told:
            if not is_trigger:
                over = False
                which = grain == "chunk"
                if unit > counts[2 + which]:
                    counts[which] += 1
                    counts[2 + which] = int(unit)
                if pd.notna(score):
                    known[detector] = _with_score(known.get(detector), grain, float(score))
                    values.pop(detector, None)
                    changed.add(detector)
                continue
            head = (key[0], seq, t, n_events, counts[0], counts[1], triggered_by)
            for name in known.keys() - values.keys():
                values[name] = _value(known[name])
            out += [(*head, name, s[0], values[name], s[2] if s[0] == "chunk" else None) for name, s in sorted(known.items())] or [
                (*head, None, None, None, None)]
            if triggered_by == "finalize":  # what follows is a new session of this name
                known, counts, over, changed, values = {}, [0, 0, -1, -1], True, set(), {}
                self.detectors.clear()
        if over:
            self.counts.clear()
        else:
            self.counts.update(tuple(counts))
            for name in changed:
                self.detectors.updateValue((name,), tuple(known[name]))
        if out:
            columns = dict(zip(_UPDATE, zip(*out)))
            yield pd.DataFrame({c: np.array(v, dtype=_KINDS.get(c, object)) for c, v in columns.items()}, copy=False)


def _with_score(state: list | None, grain: str, score: float) -> list:
    _, top, _, points, weights = state or (grain, None, None, [], [])
    if grain == "chunk":
        points, weights = sketch.add_to(list(points), list(weights), score)
        return [grain, None, score, points, weights]
    return [grain, score if top is None else max(top, score), score, [], []]


def _value(state: list) -> float:
    return sketch.quantile(np.array(state[3]), np.array(state[4]), CHUNK_QUANTILE) if state[0] == "chunk" else state[1]


def running_scores(scored: DataFrame) -> DataFrame:
    """Stream of ``scored_units`` -> stream of running values per trigger and detector."""
    spark = scored.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    return scored.groupBy("session_id").transformWithStateInPandas(RunningScores(), UPDATES, "append", "None")


def snapshots(updates: DataFrame, detectors: Detectors, prior: float = PRIOR_RISK) -> DataFrame:
    """One row per trigger: counts, per_detector, detector_logits, chunk_scores (latest ones), session_risk.

    Window detectors that have not scored show 0 in ``per_detector`` but take no part in the risk.
    """
    rows = detectors.calibrate(updates.withColumnRenamed("value", "score")).withColumn("gain", logit(F.col("p"), LOGIT_FLOOR))
    keys = ["session_id", "seq", "t", "n_events", "n_windows", "n_chunks", "triggered_by"]

    def named(value: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("detector").isNotNull() & F.col(value).isNotNull(), F.struct("detector", F.col(value))))))

    found = rows.groupBy(*keys).agg(
        named("score").alias("fired"), named("gain").alias("detector_logits"), named("latest").alias("chunk_scores"),
        sigmoid(logit(F.lit(prior), LOGIT_FLOOR) + F.coalesce(F.sum("gain"), F.lit(0.0))).alias("session_risk"))
    unfired = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(0.0)) for n in detectors.window_names]).cast(
        "array<struct<detector:string,score:double>>"))
    shown = F.map_concat(F.map_filter(unfired, lambda k, v: ~F.map_contains_key("fired", k)), "fired")
    return found.withColumn("per_detector", shown).drop("fired")


def run_scoring(messages: DataFrame, detectors: Detectors, out: str, window_ms: float = WINDOW_MS,
                chunk_len: int = CHUNK_LEN, bucket_ms: float = 1000.0, idle: str | None = None,
                lateness: str = "0 seconds", prior: float = PRIOR_RISK) -> DataFrame:
    """Process everything available; returns the snapshots under ``out/snapshots``.

    ``out`` also holds units, scores, updates and both checkpoints. Every micro-batch overwrites its own
    folders, so a replayed batch leaves no duplicates.
    """
    spark = messages.sparkSession
    scores_schema = ("session_id string, seq long, is_trigger int, unit long, grain string, detector string, score double, "
                     "t double, n_events long, triggered_by string")

    def score(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/units/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        units = batch.sparkSession.read.parquet(folder)
        features = online.unit_features(units, bucket_ms).withColumnRenamed("window_idx", "unit")
        scored_units(units, features, detectors).write.mode("overwrite").parquet(f"{out}/scores/batch_id={batch_id}")

    def publish(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/updates/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(UPDATES).parquet(folder)
        snapshots(stored, detectors, prior).write.mode("overwrite").parquet(f"{out}/snapshots/batch_id={batch_id}")

    online.run_stream(online.closed_units(messages, window_ms, chunk_len, idle, lateness), score, f"{out}/state-units")
    scored = spark.readStream.schema(f"{scores_schema}, batch_id int").parquet(f"{out}/scores").drop("batch_id")
    online.run_stream(running_scores(scored), publish, f"{out}/state-scores")
    return spark.read.parquet(f"{out}/snapshots").drop("batch_id")
