"""Event channels, chunk assembly, normalisers and chunk augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_LEN, STD_FLOOR
from ..functions.exprs import hashed, uniform
from ..functions.ordered import Ordered
from .features import norm_factor
from .windows import chunk_membership

# ---- fixed values: channel order of the event vector ----
CHANNEL_NAMES = [
    "dt", "dx", "dy", "is_mouse_move", "is_mouse_click_press", "is_mouse_scroll",
    "is_key_press", "is_key_release",
]


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def event_channels(events: DataFrame, sessions: DataFrame, slices: int = 1) -> DataFrame:
    """Eight channels per event, in array order (``seq``), unknown kinds included."""
    lagged = Ordered(("session_id",), ("seq",), slices).apply(events, lag={"_pt": "t"})
    nf = F.greatest(norm_factor(F.col("sensitivity"), F.col("dpi")), F.lit(1e-6))
    meta = sessions.select("session_id", nf.alias("_nf"))
    kind = F.col("event_type")
    steps = kind.isin("mouse_move", "mouse_scroll")
    step = lambda c: F.when(
        steps, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.col("_nf")).otherwise(0.0)
    gap = F.greatest(F.coalesce(F.col("t") - F.col("_pt"), F.lit(0.0)), F.lit(0.0))
    return lagged.join(meta, "session_id").select(
        "session_id", "seq", "t",
        F.log1p(gap).alias("dt"), step("dx").alias("dx"), step("dy").alias("dy"),
        _flag(kind == "mouse_move").alias("is_mouse_move"),
        _flag((kind == "mouse_click") & F.coalesce("pressed", F.lit(False))).alias("is_mouse_click_press"),
        _flag(kind == "mouse_scroll").alias("is_mouse_scroll"),
        _flag(kind == "key_press").alias("is_key_press"),
        _flag(kind == "key_release").alias("is_key_release"),
    )


def sampled_channels(
    samples: DataFrame, keys: Sequence[str], order: str, ms_per_tick: Column, slices: int = 1
) -> DataFrame:
    """Channels of a regularly sampled stream with columns ``x``, ``y``, ``down``.

    Deltas are first differences; a click fires on the rising edge of ``down``, the
    first sample counting when it starts pressed.
    """
    ready = samples.withColumns({
        "down": F.coalesce(F.col("down").cast("boolean"), F.lit(False)), "_one": F.lit(1)})
    lagged = Ordered(tuple(keys), (order,), slices).apply(
        ready, lag={"_px": "x", "_py": "y", "_pdown": "down", "_seen": "_one"})
    diff = lambda c: F.coalesce(F.col(c) - F.col(f"_p{c}"), F.lit(0)).cast("double")
    rising = F.col("down") & ~F.coalesce("_pdown", F.lit(False))
    zero = F.lit(0.0)
    return lagged.select(
        *keys, order,
        F.when(F.col("_seen").isNull(), 0.0).otherwise(F.log1p(F.greatest(ms_per_tick, zero))).alias("dt"),
        diff("x").alias("dx"), diff("y").alias("dy"), F.lit(1.0).alias("is_mouse_move"),
        _flag(rising).alias("is_mouse_click_press"), zero.alias("is_mouse_scroll"),
        zero.alias("is_key_press"), zero.alias("is_key_release"),
    )


def nested_tick_samples(captures: DataFrame, min_ticks: int = CHUNK_LEN, mouse_only: bool = True) -> DataFrame:
    """Explode ``tickInputs`` arrays of long enough, mouse-driven captures.

    Only the nested leaves that are used reach the scan (schema pruning); the ticks
    keep the duration per tick of their capture.
    """
    kept = captures.filter(F.size("tickInputs") >= min_ticks)
    if mouse_only:
        kept = kept.filter(~F.col("touchscreen"))
    ticks = F.greatest(F.coalesce(F.col("physicsTickCount"), F.size("tickInputs")), F.lit(1))
    return kept.select(
        "session_id", (F.col("duration") / ticks).alias("ms_per_tick"), F.posexplode("tickInputs")
    ).select(
        "session_id", "ms_per_tick", F.col("pos").cast("long").alias("seq"),
        F.col("col.x").alias("x"), F.col("col.y").alias("y"), F.col("col.isDown").alias("down"),
        F.col("col.sampleIndex").alias("sample_index"),
    )


def sample_sessions(sessions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` sessions with the smallest keyed hash (a distributed top-n)."""
    draw = hashed(seed, F.col("session_id"))
    return sessions.orderBy(draw, "session_id").limit(n)


def override_dt(channels: DataFrame, ms: float | None) -> DataFrame:
    """Replace the time channel by a constant interval, or by zero."""
    value = 0.0 if ms is None else ms
    return channels.withColumn("dt", F.log1p(F.lit(float(value))))


def fit_normaliser(channels: DataFrame, names: Sequence[str] = CHANNEL_NAMES) -> DataFrame:
    """(channel, mean, std) over all rows; a flat channel gets std 1.  Eight rows."""
    aggs = [F.avg(c).alias(f"{c}|mean") for c in names]
    aggs += [F.stddev_pop(c).alias(f"{c}|std") for c in names]
    one = channels.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"`{c}|mean`").alias("mean"),
                 F.when(F.col(f"`{c}|std`") < STD_FLOOR, 1.0).otherwise(F.col(f"`{c}|std`")).alias("std"))
        for c in names])
    return one.select(F.inline(rows))


def apply_normaliser(channels: DataFrame, stats: DataFrame, names: Sequence[str] = CHANNEL_NAMES) -> DataFrame:
    """Z-score the channels; the statistics are one broadcast row."""
    wide = stats.groupBy().agg(
        *[F.max(F.when(F.col("channel") == c, F.col("mean"))).alias(f"_m_{c}") for c in names],
        *[F.max(F.when(F.col("channel") == c, F.col("std"))).alias(f"_s_{c}") for c in names])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in names}
    return channels.crossJoin(F.broadcast(wide)).withColumns(scaled).select(*channels.columns)


def assemble_chunks(
    channels: DataFrame,
    length: int = CHUNK_LEN,
    stride: int | None = None,
    names: Sequence[str] = CHANNEL_NAMES,
    key: Sequence[str] = ("session_id",),
    slices: int = 1,
) -> DataFrame:
    """One row per full chunk with its flat ``v`` array (length x channels values).

    The collected group is one chunk, so it never exceeds ``length`` rows.
    """
    placed = chunk_membership(channels, length, stride, key, slices)
    row = F.struct("seq", F.array(*names).alias("c"))
    return placed.groupBy(*key, "chunk_idx", "start_seq").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["c"])).alias("v"))


def chunk_counts(chunks: DataFrame, key: Sequence[str] = ("session_id",)) -> DataFrame:
    return chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"))


def integrate(channels: DataFrame, slices: int = 1) -> DataFrame:
    """Trajectory from deltas (running sums in array order)."""
    return Ordered(("session_id",), ("seq",), slices).apply(
        channels, running={"px": F.col("dx"), "py": F.col("dy")})


def augment(chunks: DataFrame, seed: int, length: int = CHUNK_LEN, channels: int = 8) -> DataFrame:
    """One augmented view per chunk, drawn from keyed hashes (repeatable, retry-safe).

    Crop-resize (always), scaling of 0.7-1.3 (p .8), additive noise of 0.1 (p .5) and
    a mask over 15 % of the steps (p .5).
    """
    ident = F.concat_ws("|", "session_id", F.col("chunk_idx").cast("string"))
    u = lambda *tag: uniform(seed, ident, *tag)
    keep = F.lit(0.6) + F.lit(0.4) * u("keep")
    start = (F.lit(1.0) - keep) * u("start") * (length - 1)
    factor = F.when(u("scale?") < 0.8, F.lit(0.7) + F.lit(0.6) * u("scale")).otherwise(1.0)
    sigma = F.when(u("noise?") < 0.5, 0.1).otherwise(0.0)
    masked = max(1, round(length * 0.15))
    mask_on = u("mask?") < 0.5
    mask_at = F.floor(u("mask") * (length - masked + 1))
    base = chunks.withColumns({
        "_id": ident, "_keep": keep, "_start": start, "_factor": factor, "_sigma": sigma,
        "_mask_on": mask_on, "_mask_at": mask_at})

    def value(i: Column) -> Column:
        step, channel = F.floor(i / channels), i % channels
        at = F.col("_start") + step * F.col("_keep")
        low = F.least(F.floor(at), F.lit(length - 2).cast("long"))
        pick = lambda s: F.get("v", (s * channels + channel).cast("int"))
        interpolated = pick(low) + (pick(low + 1) - pick(low)) * (at - low)
        a = uniform(seed, F.col("_id"), "a", i)
        b = uniform(seed, F.col("_id"), "b", i)
        noise = F.sqrt(F.lit(-2.0) * F.ln(F.greatest(a, F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * b)
        hidden = F.col("_mask_on") & (step >= F.col("_mask_at")) & (step < F.col("_mask_at") + masked)
        return F.when(hidden, 0.0).otherwise(interpolated * F.col("_factor") + noise * F.col("_sigma"))

    span = F.sequence(F.lit(0), F.lit(length * channels - 1))
    return base.withColumn("v", F.transform(span, value)).select(*chunks.columns)
