"""Online windows and chunks as a stateful Structured Streaming job.

The stateful step only keeps order, counts late events, follows the device settings and
decides when a window or a chunk is complete; it emits the complete group's rows.
Features of a micro-batch are then computed by the very DataFrame operators of the batch
path, so both agree by construction.  State per session is typed: one row of counters and
settings, and the rows of the open window and the partial chunk.

Settings take effect at their place in the session: a unit is scaled by what the last
``__session__`` message before the event that completed it said, wherever micro-batches
end.  Sensitivity and dpi only count together, the polling rate on its own.

A session ends by ``__end__`` or, with ``idle``, when the watermark passes its last arrival
by that time.  With ``idle`` its state is then removed; messages between ``__end__`` and the
removal are counted and reported by a ``closed`` row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import CHUNK_LEN, REFERENCE_DPI, REFERENCE_POLLING_HZ, WINDOW_MS
from ..functions.exprs import ratio
from ..operators import features as feat
from ..session import ship_package

EVENT = "seq BIGINT, t DOUBLE, type STRING, x DOUBLE, y DOUBLE, dx DOUBLE, dy DOUBLE, pressed BOOLEAN, key STRING"
OUTPUT = (
    f"session_id STRING, kind STRING, unit BIGINT, w_start DOUBLE, w_ms DOUBLE, {EVENT}, norm_factor DOUBLE, "
    "rate_norm DOUBLE, trigger_seq BIGINT, triggered_by STRING, n_events BIGINT, late BIGINT")
SESSION_STATE = (
    "anchor DOUBLE, last_t DOUBLE, seen BIGINT, late BIGINT, window BIGINT, norm_factor DOUBLE, rate_norm DOUBLE, "
    "closed BOOLEAN, refused BIGINT, last_seq BIGINT")
ROWS_STATE = f"{EVENT}, at BIGINT"
_EVENT = [c.strip().split(" ")[0] for c in EVENT.split(",")]
_OUTPUT = [c.strip().split(" ")[0] for c in OUTPUT.split(",")]
_SESSION = [c.strip().split(" ")[0] for c in SESSION_STATE.split(",")]
_NUMBERS = ["t", "x", "y", "dx", "dy", "sensitivity", "dpi", "polling_rate"]
_WHOLE = {"unit", "seq", "trigger_seq", "n_events", "late"}
_DOUBLES = {"w_start", "w_ms", "t", "x", "y", "dx", "dy", "norm_factor", "rate_norm"}
NEW_SESSION = (None, None, 0, 0, None, 1.0, 1.0, False, 0, -1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _carried(values: np.ndarray, told: np.ndarray, before: float) -> np.ndarray:
    """The last told value at every place, ``before`` where none was."""
    at = np.maximum.accumulate(np.where(told, np.arange(len(values)), -1)) if len(values) else np.array([], int)
    return np.where(at >= 0, values[at], before) if len(values) else values


def _settings(messages: dict[str, np.ndarray], norm: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors in force after each message, in their order."""
    told = messages["type"] == "__session__"
    both = messages["sensitivity"] * messages["dpi"] / REFERENCE_DPI
    hz = messages["polling_rate"]
    rates = np.divide(REFERENCE_POLLING_HZ, hz, out=np.ones(len(hz)), where=hz > 0)
    return (_carried(np.maximum(both, 1e-6), told & ~np.isnan(both), norm), _carried(rates, told & ~np.isnan(hz), rate))


def _columns(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """Message columns as arrays: text and flags as objects with None, numbers as doubles with NaN."""
    out = {c: frame[c].to_numpy(float) for c in _NUMBERS}
    out["seq"] = frame["seq"].to_numpy(np.int64)
    for c in ("type", "pressed", "key"):
        values = frame[c].to_numpy(object)
        out[c] = np.where(pd.isna(values), None, values)
    return out


def _rows(columns: dict[str, np.ndarray], some: np.ndarray) -> list[tuple]:
    """State rows of the chosen events."""
    parts = []
    for c in (*_EVENT, "at"):
        values = columns[c][some]
        plain = values.astype(object) if values.dtype != float else np.where(np.isnan(values), None, values.astype(object))
        parts.append(plain.tolist())
    return list(zip(*parts))


class Held:
    """Rows of the open window and the partial chunk, and how they differ from the state."""

    def __init__(self, columns: dict[str, np.ndarray], some: np.ndarray, stored: int):
        self.columns, self.some, self.stored, self.changed, self.added = columns, some, stored, False, 0


class Units:
    """Output rows of one call, collected as arrays and turned into one frame."""

    def __init__(self):
        self.parts: list[tuple[int, dict]] = []

    def add(self, events: dict[str, np.ndarray] | None, kind: str, n: int = 1, **values) -> None:
        if n:
            self.parts.append((n, (events or {}) | values | {"kind": kind}))

    def frame(self, key, now: dict) -> Iterator[pd.DataFrame]:
        if not self.parts:
            return
        total = sum(n for n, _ in self.parts)
        columns = {}
        for name in _OUTPUT:
            whole, number = name in _WHOLE, name in _DOUBLES
            values = np.zeros(total, np.int64) if whole else np.full(total, np.nan if number else None, float if number else object)
            absent, at = np.ones(total, bool), 0
            for n, part in self.parts:
                if part.get(name) is not None:
                    values[at:at + n], absent[at:at + n] = part[name], False
                at += n
            columns[name] = pd.arrays.IntegerArray(values, absent) if whole else values
        yield pd.DataFrame(columns, copy=False).assign(session_id=key[0], late=now["late"])


class SessionUnits(StatefulProcessor):
    """Rows of complete windows and chunks, one row per event that completed some, one at the end."""

    def __init__(self, window_ms: float, chunk_len: int, idle_ms: int | None):
        self.window_ms, self.chunk_len, self.idle_ms = window_ms, chunk_len, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION_STATE)
        self.open_rows = handle.getListState("open_rows", ROWS_STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # A micro-batch is bounded by the source's admission limits; its messages of a session are put in order.
        messages = pd.concat(list(rows), ignore_index=True)
        known = self.session.get()
        now = dict(zip(_SESSION, NEW_SESSION if known is None else known))
        if self.idle_ms is not None:
            self._wake(int(messages["received"].max().timestamp() * 1000) + self.idle_ms)
        units = Units()
        if not now["closed"]:
            told = _columns(messages)
            order = np.argsort(told["seq"], kind="stable")
            end = np.flatnonzero(told["type"][order] == "__end__")
            kept = {c: v[order[:end[0]] if len(end) else order] for c, v in told.items()}
            held = self._held(now)
            self._advance(kept, now, held, units)
            if len(end):
                self._finish(now, held, units)
                now["closed"], now["refused"] = True, len(messages) - int(end[0]) - 1
            if held.changed and len(held.some):
                self.open_rows.put(_rows(held.columns, held.some))
            elif held.changed:
                if held.stored:
                    self.open_rows.clear()
            elif held.added:
                self.open_rows.appendList(_rows(held.columns, held.some[-held.added:]))
        else:
            now["refused"] += len(messages)
        self.session.update(tuple(now[c] for c in _SESSION))
        yield from units.frame(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = dict(zip(_SESSION, self.session.get()))
        units = Units()
        if not now["closed"]:
            self._finish(now, self._held(now), units)
        units.add(None, "closed", unit=now["refused"], t=now["last_t"])
        self.session.clear()
        self.open_rows.clear()
        yield from units.frame(key, now)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            if timer >= at:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _held(self, now: dict) -> Held:
        rows = list(self.open_rows.get()) if now["seen"] else []
        parts = list(zip(*rows)) if rows else [()] * (len(_EVENT) + 1)
        kinds = {"seq": np.int64, "at": np.int64, "type": object, "pressed": object, "key": object}
        columns = {}
        for c, values in zip((*_EVENT, "at"), parts):
            column = np.empty(len(values), dtype=kinds.get(c, float))
            column[:] = values if c in kinds else [np.nan if v is None else v for v in values]
            columns[c] = column
        return Held(columns, np.arange(len(rows)), len(rows))

    def _advance(self, messages: dict[str, np.ndarray], now: dict, held: Held, units: Units) -> None:
        """Fold messages in and add what they complete; ``now`` and the held rows are brought forward."""
        norms, rates = _settings(messages, now["norm_factor"], now["rate_norm"])
        if len(norms):
            now["norm_factor"], now["rate_norm"] = float(norms[-1]), float(rates[-1])
        t = np.nan_to_num(messages["t"], nan=0.0, posinf=np.inf, neginf=-np.inf)
        events = np.flatnonzero(messages["type"] != "__session__")
        if not len(events):
            return
        before = np.maximum.accumulate(np.append(-np.inf if now["last_t"] is None else now["last_t"], t[events]))[:-1]
        good = t[events] >= before
        now["late"] += int((~good).sum())
        events = events[good]
        if not len(events):
            return
        norms, rates, t, seq = norms[events], rates[events], t[events], messages["seq"][events]
        if now["anchor"] is None:
            now["anchor"], now["window"] = float(t[0]), 0
        at = now["seen"] + np.arange(len(events))
        window = np.floor((t - now["anchor"]) / self.window_ms).astype(np.int64)
        was = np.append(now["window"], window[:-1])
        crossed, full = window > was, (at + 1) % self.chunk_len == 0
        fresh = {c: messages[c][events] for c in _EVENT} | {"t": t, "at": at}
        n_held = len(held.some)
        held.columns = {c: np.concatenate([v[held.some], fresh[c]]) for c, v in held.columns.items()}
        # a held row can belong to an earlier window if its chunk is still open
        windows = np.floor((held.columns["t"] - now["anchor"]) / self.window_ms).astype(np.int64)
        chunks = held.columns["at"] // self.chunk_len
        for i, number, places, kind in (
                (np.flatnonzero(crossed), was, windows, "window"), (np.flatnonzero(full), at // self.chunk_len, chunks, "chunk")):
            low, high = np.searchsorted(places, number[i]), np.searchsorted(places, number[i] + 1)  # both are in order
            if kind == "window":
                i, low, high = (v[high - low >= 2] for v in (i, low, high))
            size = high - low
            start = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            each = np.repeat(i, size)
            spans = {"w_start": now["anchor"] + number[each] * self.window_ms, "w_ms": self.window_ms} if kind == "window" else {}
            units.add({c: v[start] for c, v in held.columns.items()}, kind, len(each), unit=number[each],
                      norm_factor=norms[each], rate_norm=rates[each], trigger_seq=seq[each], **spans)
        fired = np.flatnonzero(crossed | full)
        units.add({"type": fresh["type"][fired]}, "trigger", len(fired), seq=seq[fired], t=t[fired], norm_factor=norms[fired],
                  rate_norm=rates[fired], trigger_seq=seq[fired], n_events=at[fired] + 1,
                  triggered_by=np.where(full[fired], "chunk", "window").astype(object))
        now["last_t"], now["seen"], now["window"] = float(t[-1]), int(at[-1]) + 1, int(window[-1])
        now["last_seq"] = int(seq[-1])
        if len(fired):
            held.some = np.flatnonzero((windows >= now["window"]) | (chunks >= now["seen"] // self.chunk_len))
            held.changed = True
        else:
            held.some, held.added = np.arange(len(windows)), len(windows) - n_held

    def _finish(self, now: dict, held: Held, units: Units) -> None:
        """The trailing window by its real length, and the last trigger; a partial chunk is dropped."""
        scale = {"norm_factor": now["norm_factor"], "rate_norm": now["rate_norm"]}
        if now["seen"]:
            start = now["anchor"] + now["window"] * self.window_ms
            at = held.some[np.floor((held.columns["t"][held.some] - now["anchor"]) / self.window_ms) == now["window"]]
            if len(at) >= 2 and now["last_t"] > start:
                units.add({c: v[at] for c, v in held.columns.items()}, "window", len(at), unit=now["window"], w_start=start,
                          w_ms=min(self.window_ms, now["last_t"] - start), trigger_seq=now["last_seq"] + 1, **scale)
            units.add(None, "trigger", seq=now["last_seq"] + 1, t=now["last_t"], trigger_seq=now["last_seq"] + 1,
                      triggered_by="finalize", n_events=now["seen"], **scale)
        units.add(None, "end", unit=now["seen"], t=now["last_t"], **scale)
        held.some, held.changed = held.some[:0], held.changed or now["seen"] > 0


def closed_units(messages: DataFrame, window_ms: float = WINDOW_MS, chunk_len: int = CHUNK_LEN,
                 idle: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Stream of messages -> stream of rows of complete windows and chunks.

    ``idle`` (as "10 minutes") needs a ``received`` timestamp in the messages; its watermark allows ``lateness``.
    """
    spark = messages.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    idle_ms = None
    if idle is not None:
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
        messages = messages.withWatermark("received", lateness)
    return messages.groupBy("session_id").transformWithStateInPandas(
        SessionUnits(window_ms, chunk_len, idle_ms), OUTPUT, "append", "EventTime" if idle else "None")


def unit_features(units: DataFrame, bucket_ms: float = 1000.0) -> DataFrame:
    """Window features of emitted rows through the batch operators.

    Rows carry their scale factors, so these are part of the grouping.
    """
    keys = ("session_id", "window_idx", "trigger_seq", "norm_factor", "rate_norm")
    rows = units.filter("kind = 'window'").withColumnsRenamed({"type": "event_type", "unit": "window_idx"})
    raw = feat.raw_window_features(rows, keys, bucket_ms)
    scaled = {c: ratio(F.col(c), F.col("norm_factor")) for c in feat.SPEED_SCALED}
    scaled |= {c: F.col(c) * F.col("rate_norm") for c in feat.RATE_SCALED}
    return raw.withColumns(scaled).drop("norm_factor", "rate_norm")


def run_stream(stream: DataFrame, sink, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_online(messages: DataFrame, out: str, checkpoint: str, window_ms: float = WINDOW_MS,
               chunk_len: int = CHUNK_LEN, bucket_ms: float = 1000.0, idle: str | None = None,
               lateness: str = "0 seconds") -> None:
    """Process everything available; features under ``out/features``, units under ``out/units``.

    Each micro-batch overwrites its own folder, so a replayed batch leaves no duplicates.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/units/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.parquet(folder)
        unit_features(stored, bucket_ms).write.mode("overwrite").parquet(f"{out}/features/batch_id={batch_id}")

    run_stream(closed_units(messages, window_ms, chunk_len, idle, lateness), sink, checkpoint)


def replay_messages(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Recorded tables as the message sequence a live client would have sent."""
    none = lambda kind: F.lit(None).cast(kind)
    body = events.select(
        "session_id", "seq", F.col("event_type").alias("type"), "t",
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "dx", "dy")], "pressed", "key",
        *[none("double").alias(c) for c in ("sensitivity", "dpi", "polling_rate")])
    empty = [none("double").alias(c) for c in ("t", "x", "y", "dx", "dy")]
    rest = [none("boolean").alias("pressed"), none("string").alias("key")]
    opening = sessions.select(
        "session_id", F.lit(-1).cast("long").alias("seq"), F.lit("__session__").alias("type"), *empty, *rest,
        *[F.col(c).cast("double").alias(c) for c in ("sensitivity", "dpi", "polling_rate")])
    closing = sessions.select(
        "session_id", F.lit(2 ** 62).cast("long").alias("seq"), F.lit("__end__").alias("type"), *empty, *rest,
        *[none("double").alias(c) for c in ("sensitivity", "dpi", "polling_rate")])
    return body.unionByName(opening).unionByName(closing)


def stream_table(spark: SparkSession, folder: str, per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(folder if glob is None else f"{folder}/{glob}").schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def running_updates(scores: DataFrame, slices: int = 1) -> DataFrame:
    """Session updates in trigger order: highest score so far and the live risk.

    Input (session_id, at, triggered_by, detector, p); detectors that have not fired are
    absent from the risk sum.
    """
    from ..constants import LOGIT_FLOOR, PRIOR_RISK
    from ..functions.exprs import logit, sigmoid
    from ..functions.ordered import Ordered
    best = Ordered(("session_id", "detector"), ("at",), slices).apply(scores, highest={"_before": F.col("p")})
    now = F.greatest(F.col("p"), F.col("_before"))
    gain = logit(now, LOGIT_FLOOR) - F.coalesce(logit(F.col("_before"), LOGIT_FLOOR), F.lit(0.0))
    walked = best.withColumns({"top": now, "_gain": gain})
    total = Ordered(("session_id",), ("at", "detector"), slices).apply(walked, running={"_sum": F.col("_gain")})
    return total.select("session_id", "at", "triggered_by", "detector", "top",
                        sigmoid(logit(F.lit(PRIOR_RISK), LOGIT_FLOOR) + F.col("_sum")).alias("risk"))


def tumbling_counts(events: DataFrame, every: str, late: str, time: str = "ts") -> DataFrame:
    """Watermarked counts per user-independent window and kind."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), "event_type").agg(
        F.count(F.lit(1)).alias("n"))


def idle_session_counts(events: DataFrame, gap: str, late: str, time: str = "ts") -> DataFrame:
    """Watermarked counts per user and idle-gap session."""
    return events.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap)).agg(
        F.count(F.lit(1)).alias("n"))
