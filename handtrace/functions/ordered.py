"""Order-dependent columns and exact percentiles that survive a giant group.

A plain Spark window puts one group into one task.  Every operator here takes
``slices``: 1 means "no group is larger than one task should hold" and yields an
ordinary window; a larger number cuts each oversized group into contiguous runs of
its order column, evaluates the window per run, and carries the tail of earlier
runs forward through a table holding one row per run.  Both forms give the same
rows.  ``measure_slices`` picks the number from the real size of the largest group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_SLICE = 2_000_000
_COARSE = 64


def slices_for(rows: int) -> int:
    """Slices needed so that a group of ``rows`` rows fits tasks of ``ROWS_PER_SLICE``."""
    return max(1, math.ceil(rows / ROWS_PER_SLICE))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys meet, as they do in a window or grouping."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(and_, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_key_{k}" for k in keys])


def measure_slices(df: DataFrame, keys: Sequence[str]) -> int:
    """Count the largest group (one partially aggregated pass over the key columns)."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return slices_for(largest)


def _slice_of(cuts: Column, value: Column, slices: int) -> Column:
    """How many ascending cut points lie below ``value`` (two-level search)."""
    if slices <= 2 * _COARSE:
        return F.size(F.filter(cuts, lambda c: c < value))
    step = math.ceil(slices / _COARSE)
    coarse = F.filter(cuts, lambda c, i: (i % step == step - 1) & (c < value))
    skipped = F.size(coarse) * step
    fine = F.filter(F.slice(cuts, skipped + 1, F.lit(step)), lambda c: c < value)
    return skipped + F.size(fine)


def with_slices(
    df: DataFrame, keys: Sequence[str], value: str, slices: int, out: str = "_slice"
) -> DataFrame:
    """Tag rows with a run number: contiguous in ``value``, near-equal in size.

    Only groups above the average slice size are cut, so the cut table has at most
    ``rows / slice size`` rows; ordinary groups keep run 0.
    """
    points = [i / slices for i in range(1, slices)]
    size = F.count(F.lit(1))
    cuts = df.groupBy(*keys).agg(
        size.alias("_n"),
        F.percentile_approx(F.col(value), F.array(*map(F.lit, points)), max(10_000, 8 * slices)).alias("_cuts"),
    )
    floor_rows = cuts.agg(F.max("_n").alias("_max"))
    cuts = (
        cuts.crossJoin(F.broadcast(floor_rows))  # one-row table
        .filter(F.col("_n") * slices > F.col("_max"))
        .select(*keys, F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))
    )
    if keys:
        tagged = join_keys(df, cuts, keys, "left")
    else:
        tagged = df.join(F.broadcast(cuts), F.lit(True), "left")  # one row
    number = F.coalesce(_slice_of(F.col("_cuts"), F.col(value), slices), F.lit(0))
    return tagged.withColumn(out, number).drop("_cuts")


@dataclass(frozen=True)
class Ordered:
    """Window computations over ``keys`` ordered by ``order`` (a total order)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slices: int = 1
    reverse: bool = False

    def _sorting(self) -> list[Column]:
        return [F.col(c).desc() if self.reverse else F.col(c).asc() for c in self.order]

    def apply(
        self,
        df: DataFrame,
        lag: Mapping[str, str] | None = None,
        last: Mapping[str, Column] | None = None,
        running: Mapping[str, Column] | None = None,
        position: str | None = None,
        highest: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Add columns.

        ``lag``: value of a column on the previous row.  ``last``: latest non-null
        value of an expression on the rows before.  ``running``: sum up to and
        including the row.  ``position``: 0-based row number.  ``highest``: maximum
        of an expression on the rows before.
        """
        lag, last, running, highest = lag or {}, last or {}, running or {}, highest or {}
        if self.slices <= 1:
            return self._local(df, self.keys, lag, last, running, position, highest)
        return self._sliced(df, lag, last, running, position, highest)

    def _local(self, df, keys, lag, last, running, position, highest):
        w = Window.partitionBy(*keys).orderBy(*self._sorting())
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cols = {out: F.lag(src).over(w) for out, src in lag.items()}
        cols |= {out: F.last(e, ignorenulls=True).over(before) for out, e in last.items()}
        cols |= {out: F.sum(e).over(upto) for out, e in running.items()}
        cols |= {out: F.max(e).over(before) for out, e in highest.items()}
        if position:
            cols[position] = (F.row_number().over(w) - 1).cast("long")
        return df.withColumns(cols)

    def _sliced(self, df, lag, last, running, position, highest):
        keys = list(self.keys)
        runs = [*keys, "_slice"]
        # Runs, carry and result all read the tagged rows: write them once, so that a
        # chain of ordered steps neither recomputes nor multiplies its plan.
        cut = cut_lineage(with_slices(df, keys, self.order[0], self.slices))
        ordinal = [F.col(c) for c in self.order]
        edge = F.min if self.reverse else F.max

        ends = [F.count(F.lit(1)).alias("_walk_rows")]
        if lag:
            ends.append(
                edge(F.struct(*ordinal, *[F.col(s).alias(f"_v_{o}") for o, s in lag.items()]))
                .alias("_walk_tail")
            )
        for out, e in last.items():
            ends.append(
                edge(F.when(e.isNotNull(), F.struct(*ordinal, e.alias("_v")))).alias(f"_l_{out}")
            )
        for out, e in running.items():
            ends.append(F.sum(e).alias(f"_s_{out}"))
        for out, e in highest.items():
            ends.append(F.max(e).alias(f"_h_{out}"))

        way = F.col("_slice").desc() if self.reverse else F.col("_slice").asc()
        w = Window.partitionBy(*keys).orderBy(way)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.coalesce(F.sum("_walk_rows").over(before), F.lit(0)).alias("_carry_rows")]
        if lag:
            carried.append(F.lag("_walk_tail").over(w).alias("_carry_tail"))
        for out in last:
            carried.append(
                F.last(F.col(f"_l_{out}"), ignorenulls=True).over(before)["_v"].alias(f"_carry_{out}")
            )
        for out in running:
            carried.append(F.sum(f"_s_{out}").over(before).alias(f"_carry_{out}"))
        for out in highest:
            carried.append(F.max(f"_h_{out}").over(before).alias(f"_carry_{out}"))
        carry = cut.groupBy(*runs).agg(*ends).select(*runs, *carried)

        local = self._local(cut, runs, lag, last, running, "_walk_at", highest)
        joined = join_keys(local, carry, runs, "left")
        fixed = {
            out: F.when(F.col("_walk_at") == 0, F.col("_carry_tail")[f"_v_{out}"]).otherwise(F.col(out))
            for out in lag
        }
        fixed |= {out: F.coalesce(F.col(out), F.col(f"_carry_{out}")) for out in last}
        fixed |= {
            out: F.when(F.col(out).isNull(), F.col(f"_carry_{out}")).otherwise(
                F.col(out) + F.coalesce(F.col(f"_carry_{out}"), F.lit(0))
            )
            for out in running
        }
        fixed |= {out: F.greatest(F.col(out), F.col(f"_carry_{out}")) for out in highest}
        if position:
            fixed[position] = (F.col("_walk_at") + F.col("_carry_rows")).cast("long")
        out = joined.withColumns(fixed)
        added = [*lag, *last, *running, *highest, *([position] if position else [])]
        return out.select(*[c for c in df.columns if c not in added], *added)


def group_extent(
    df: DataFrame, keys: Sequence[str], extents: Mapping[str, Column], slices: int
) -> DataFrame:
    """Attach whole-group aggregates to every row.

    Without oversized groups this is a window on the group's own partition (no
    shuffle beyond the group's); otherwise a map-side combined aggregate is joined.
    """
    if slices <= 1:
        w = Window.partitionBy(*keys)
        return df.withColumns({out: agg.over(w) for out, agg in extents.items()})
    stats = df.groupBy(*keys).agg(*[agg.alias(out) for out, agg in extents.items()])
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # one row
    return join_keys(df, stats, keys, "left")


def group_percentile(
    df: DataFrame, keys: Sequence[str], out: str, value: str, p: float, slices: int
) -> DataFrame:
    """Attach an exact group percentile to every row."""
    if slices <= 1:
        return df.withColumn(out, F.percentile(value, F.lit(p)).over(Window.partitionBy(*keys)))
    return join_keys(df, exact_percentiles(df, keys, {out: (value, p)}, slices), keys, "left")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    slices: int = 1,
) -> DataFrame:
    """Linearly interpolated percentiles per group, one row per group."""
    return aggregate(df, keys, [], wanted, slices)


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    percentiles: Mapping[str, tuple[str, float]] | None = None,
    slices: int = 1,
) -> DataFrame:
    """``groupBy(keys).agg(...)`` plus exact percentiles in one pass.

    Spark's ``percentile`` keeps a group's distinct values in one buffer.  With
    ``slices`` > 1 the values are ranked over the sliced running count instead, so
    no task ever holds a whole group.
    """
    percentiles = percentiles or {}
    by_value: dict[str, dict[str, float]] = {}
    for out, (value, p) in percentiles.items():
        by_value.setdefault(value, {})[out] = p

    if slices <= 1:
        arrays = [
            F.percentile(v, F.array(*[F.lit(float(p)) for p in ps.values()])).alias(f"_pct{i}")
            for i, (v, ps) in enumerate(by_value.items())
        ]
        picked = [
            F.col(f"_pct{i}")[j].alias(out)
            for i, ps in enumerate(by_value.values())
            for j, out in enumerate(ps)
        ]
        plain = df.groupBy(*keys).agg(*aggs, *arrays)
        return plain.select(
            *[c for c in plain.columns if not c.startswith("_pct")], *picked
        )

    df = cut_lineage(df) if by_value else df
    base = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_walk_rows")]))
    for value, ps in by_value.items():
        ranked = _ranked_values(df, keys, value, slices)
        parts = []
        for out, p in ps.items():
            pos = F.lit(float(p)) * (F.col("_total") - 1)
            below, at = F.col("_cum") - F.col("_count"), F.col("_cum")
            for tag, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
                parts.append(F.max(F.when((below <= r) & (r < at), F.col(value))).alias(f"_{tag}_{out}"))
        picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *parts)
        cols = []
        for out, p in ps.items():
            pos = F.lit(float(p)) * (F.col("_total") - 1)
            lo, hi = F.col(f"_lo_{out}"), F.col(f"_hi_{out}")
            cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(out))
        picked = picked.select(*keys, *cols)
        base = join_keys(base, picked, keys, "left") if keys else base.crossJoin(F.broadcast(picked))
    return base.drop("_walk_rows") if not aggs else base


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str, slices: int) -> DataFrame:
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    run = Ordered(tuple(keys), (value,), slices).apply(counts, running={"_cum": F.col("_count")})
    totals = counts.groupBy(*keys).agg(F.sum("_count").alias("_total"))
    return join_keys(run, totals, keys) if keys else run.crossJoin(F.broadcast(totals))
