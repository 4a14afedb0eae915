"""Distribution comparison: drift, rank tests, correlations, descriptions.

Everything ranks ``(key, value) -> counts`` first and runs totals over the distinct
values, through ``Ordered``, so no task has to hold a whole column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PSI_FLOOR, PSI_MODERATE, PSI_SIGNIFICANT
from ..functions.exprs import ratio
from ..functions.ordered import Ordered, aggregate, exact_percentiles, join_keys
from ..session import cut_lineage

KS_ALPHA = 0.05
RANK_TEST_MIN = 20
GRID_CELL = 4096


def upright(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., feature, value) without NULLs."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), "feature", "value").filter(F.col("value").isNotNull())


def _value_counts(long: DataFrame, keys: Sequence[str], sides: dict[str, Column]) -> DataFrame:
    return long.groupBy(*keys, "value").agg(
        *[F.sum(F.when(cond, 1).otherwise(0)).alias(side) for side, cond in sides.items()])


def _runs(long: DataFrame, is_current: Column, keys: Sequence[str], slices: int) -> DataFrame:
    """Distinct values with side counts, running side totals and the side sizes."""
    counts = _value_counts(long, keys, {"_r": ~is_current, "_c": is_current})
    run = Ordered(tuple(keys), ("value",), slices).apply(
        counts, running={"_cr": F.col("_r"), "_cc": F.col("_c")})
    totals = counts.groupBy(*keys).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    return join_keys(run, totals, keys)


def ks_statistic(long: DataFrame, is_current: Column, keys: Sequence[str] = ("feature",), slices: int = 1) -> DataFrame:
    """(keys, ks_stat, n_ref, n_cur): largest gap of the two empirical distributions."""
    return _ks(_runs(long, is_current, keys, slices), keys)


def _ks(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(ratio(F.col("_cr"), F.col("n_ref")) - ratio(F.col("_cc"), F.col("n_cur")))
    return runs.groupBy(*keys, "n_ref", "n_cur").agg(F.max(gap).alias("ks_stat"))


def ks_p_value(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value (alternating Kolmogorov series)."""
    en = F.sqrt(n.cast("double") * m / (n + m))
    lam = en * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * j * j * lam * lam))
    return F.when(stat.isNull(), None).when(lam < 0.04, 1.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series)))


def psi(long: DataFrame, is_current: Column, keys: Sequence[str] = ("feature",), bins: int = 10,
        slices: int = 1) -> DataFrame:
    """(keys, psi) with bins at the reference quantiles; NULL for an empty side or a
    constant reference."""
    return _psi(_runs(long, is_current, keys, slices), keys, bins)


def _edges(runs: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, n_ref, n_cur, _edges, _inner): quantiles of the reference, of which only the inner ones bound bins."""
    # Quantiles are read off the running reference counts: the value holding rank r.
    ends = []
    for i in range(bins + 1):
        pos = F.lit(i / bins) * (F.col("n_ref") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("_cr") - F.col("_r") <= rank) & (rank < F.col("_cr"))
            ends.append(F.max(F.when(holds, F.col("value"))).alias(f"_{tag}{i}"))
    ranked = runs.groupBy(*keys, "n_ref", "n_cur").agg(*ends)
    quantiles = []
    for i in range(bins + 1):
        pos = F.lit(i / bins) * (F.col("n_ref") - 1)
        quantiles.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos)))
    edges = F.array_sort(F.array_distinct(F.array_compact(F.array(*quantiles))))
    return ranked.select(*keys, "n_ref", "n_cur", edges.alias("_edges")).withColumn(
        "_inner", F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0))))


def _psi(runs: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    cuts = _edges(runs, keys, bins)
    placed = join_keys(runs.select(*keys, "value", "_r", "_c"), cuts, keys).withColumn(
        "_bin", F.size(F.filter("_inner", lambda e: e <= F.col("value"))))
    held = placed.groupBy(*keys, "_bin").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    return _divergence(cuts, held, keys)


def _divergence(cuts: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI from the counts (keys, _bin, _r, _c) of the bins that hold something."""
    grid = cuts.select(*keys, "n_ref", "n_cur", "_edges",
                       F.explode(F.sequence(F.lit(0), F.size("_inner"))).alias("_bin"))
    full = join_keys(grid, held, [*keys, "_bin"], "left")
    share = lambda c, n: F.greatest(
        ratio(F.coalesce(F.col(c), F.lit(0)), F.col(n)), F.lit(PSI_FLOOR))
    part = full.withColumns({"_pr": share("_r", "n_ref"), "_pc": share("_c", "n_cur")})
    term = (F.col("_pc") - F.col("_pr")) * F.ln(F.col("_pc") / F.col("_pr"))
    usable = (F.max(F.size("_edges")) >= 2) & (F.max("n_ref") > 0) & (F.max("n_cur") > 0)
    return part.groupBy(*keys).agg(F.when(usable, F.sum(term)).alias("psi"))


def severity(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(value < PSI_MODERATE, "none")
        .when(value < PSI_SIGNIFICANT, "moderate").otherwise("significant"))


def drift_report(long: DataFrame, is_current: Column, keys: Sequence[str] = ("feature",), bins: int = 10,
                 slices: int = 1) -> DataFrame:
    """KS and PSI per key, worst PSI first."""
    runs = _runs(long, is_current, keys, slices)
    return _report(join_keys(_ks(runs, keys), _psi(runs, keys, bins), keys, "left"), keys)


def _report(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p-value, severity and verdict of (keys, n_ref, n_cur, ks_stat, psi)."""
    p = ks_p_value(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))
    return report.withColumns({
        "ks_pvalue": p, "psi_severity": severity(F.col("psi")),
    }).withColumn("ks_drifted", F.coalesce(F.col("ks_pvalue") < KS_ALPHA, F.lit(False))).orderBy(
        F.col("psi").desc_nulls_last(), *keys)


def drift_against(long: DataFrame, target: str, base: str, keys: Sequence[str] = ("feature",), bins: int = 10,
                  slices: int = 1) -> DataFrame:
    """The drift report of every other value of ``target`` against ``base``, keyed by (target, keys).

    All targets share one relation of (keys, value) counts with the running count of the base. The largest
    gap of two distributions lies at a value of the target or just before one, so the base is never copied;
    its bins and their shares are found once and met by the targets' own counts.
    """
    both = ["target", *keys]
    counts = cut_lineage(long.groupBy(F.col(target).alias("target"), *keys, "value").agg(F.count(F.lit(1)).alias("_c")))
    is_base = F.col("target").eqNullSafe(F.lit(base))
    values = counts.groupBy(*keys, "value").agg(F.sum(F.when(is_base, F.col("_c")).otherwise(0)).alias("_r"))
    values = Ordered(tuple(keys), ("value",), slices).apply(values, running={"_cr": F.col("_r")})
    size = values.groupBy(*keys).agg(F.sum("_r").alias("n_ref"))
    others = counts.where(~is_base)
    run = Ordered(tuple(both), ("value",), slices).apply(others, running={"_cc": F.col("_c")})
    sizes = others.groupBy(*both).agg(F.sum("_c").alias("n_cur"))
    placed = join_keys(join_keys(join_keys(run, values, [*keys, "value"]), sizes, both), size, keys)
    here = F.abs(ratio(F.col("_cr"), F.col("n_ref")) - ratio(F.col("_cc"), F.col("n_cur")))
    before = F.abs(ratio(F.col("_cr") - F.col("_r"), F.col("n_ref")) - ratio(F.col("_cc") - F.col("_c"), F.col("n_cur")))
    ks = placed.groupBy(*both, "n_ref", "n_cur").agg(F.max(F.greatest(here, before)).alias("ks_stat"))
    cuts = _edges(join_keys(values.where("_r > 0").withColumn("n_cur", F.lit(0)), size, keys), keys, bins).drop("n_cur")
    bin_ = F.size(F.filter("_inner", lambda e: e <= F.col("value")))
    own = join_keys(others, cuts.select(*keys, "_inner"), keys).groupBy(*both, bin_.alias("_bin")).agg(F.sum("_c").alias("_c"))
    base_bins = join_keys(values.where("_r > 0"), cuts.select(*keys, "_inner"), keys).groupBy(*keys, bin_.alias("_bin")).agg(
        F.sum("_r").alias("_r"))
    names = sizes.select(*both)
    held = join_keys(join_keys(names, base_bins, keys), own, [*both, "_bin"], "full_outer")
    psi_ = _divergence(join_keys(sizes, cuts, keys).select(*both, "n_ref", "n_cur", "_edges", "_inner"), held, both)
    return _report(join_keys(ks, psi_, both, "left"), both)


def mid_ranks(long: DataFrame, keys: Sequence[str], sides: dict[str, Column], slices: int = 1) -> DataFrame:
    """Distinct values with per-side counts, tie size ``_m`` and average rank ``_rank``."""
    counts = _value_counts(long, keys, sides)
    counts = counts.withColumn("_m", sum(F.col(s) for s in sides))
    if slices > 1:  # cut points and ranks read the counts: what makes the values runs once
        counts = cut_lineage(counts)
    run = Ordered(tuple(keys), ("value",), slices).apply(counts, running={"_upto": F.col("_m")})
    return run.withColumn("_rank", F.col("_upto") - (F.col("_m") - 1) / 2.0)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series below 2, a continued fraction from there on."""
    square = 2.0 * x * x
    series, fraction = F.lit(1.0), x
    for k in range(40, 0, -1):
        series = 1.0 + square / (2 * k + 1) * series
    for k in range(60, 0, -1):
        fraction = x + (k / 2) / fraction
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.0, 1.0 - 2.0 * x * scale * series).otherwise(scale / fraction)


def normal_tail(z: Column) -> Column:
    """Two-sided standard normal tail, to nearly full relative precision far out as well."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def mann_whitney(long: DataFrame, is_second: Column, keys: Sequence[str] = ("feature",),
                 min_rows: int = RANK_TEST_MIN, slices: int = 1) -> DataFrame:
    """U of the first side, rank-biserial effect and two-sided p (tie corrected)."""
    ranks = mid_ranks(long, keys, {"_a": ~is_second, "_b": is_second}, slices)
    s = ranks.groupBy(*keys).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_rank")).alias("_ra"),
        F.sum(F.pow("_m", F.lit(3)) - F.col("_m")).alias("_ties"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    u = F.col("_ra") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = ratio(F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0)), sd)
    tested = s.filter((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows)).select(
        *keys, "n_a", "n_b", u.alias("u"), (ratio(2 * u, a * b) - 1).alias("effect"), z.alias("_z"))
    return tested.withColumn("p_value", normal_tail(F.col("_z"))).drop("_z")


def kruskal(long: DataFrame, group: str, groups: Sequence[str], keys: Sequence[str] = ("feature",),
            slices: int = 1) -> DataFrame:
    """Tie-corrected H over the named groups, with degrees of freedom."""
    sides = {f"_g{i}": F.col(group) == g for i, g in enumerate(groups)}
    ranks = mid_ranks(long.filter(F.col(group).isin(list(groups))), keys, sides, slices)
    sums = ranks.groupBy(*keys).agg(
        F.sum("_m").alias("_n"), F.sum(F.pow("_m", F.lit(3)) - F.col("_m")).alias("_ties"),
        *[F.sum(s).alias(f"{s}_n") for s in sides],
        *[F.sum(F.col(s) * F.col("_rank")).alias(f"{s}_r") for s in sides])
    n = F.col("_n").cast("double")
    parts = sum(F.coalesce(ratio(F.col(f"{s}_r") * F.col(f"{s}_r"), F.col(f"{s}_n")), F.lit(0.0)) for s in sides)
    present = sum(F.when(F.col(f"{s}_n") > 0, 1).otherwise(0) for s in sides)
    h = (12.0 / (n * (n + 1)) * parts - 3 * (n + 1))
    return sums.select(
        *keys, F.col("_n").alias("n"), ratio(h, 1 - F.col("_ties") / (n * n * n - n)).alias("h"), (present - 1).alias("df"))


def chi2_tail(x: Column, df: Column, root_erfc: Column | None = None) -> Column:
    """Upper tail of the chi-squared distribution for any whole number of degrees of freedom: a finite sum.

    Terms are kept as logarithms, so that none overflows. ``root_erfc``: erfc(sqrt(x / 2)), if it is at hand.
    """
    half = x / 2.0
    root_erfc = erfc(F.sqrt(half)) if root_erfc is None else root_erfc
    odd = F.pmod(df, F.lit(2))
    start = F.when(odd == 1, F.ln(half) / 2 - math.lgamma(1.5)).otherwise(0.0)
    steps = F.when(df - odd >= 2, F.sequence(F.lit(1), ((df - odd) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    terms = F.aggregate(
        steps, F.struct(start.cast("double").alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["log"] + F.ln(half) - F.ln(i + odd / 2)).alias("log"),
                                (acc["sum"] + F.exp(acc["log"] - half)).alias("sum")))["sum"]
    tail = F.when(half > 0, terms + F.when(odd == 1, root_erfc).otherwise(0.0)).otherwise(1.0)
    return F.when(df >= 1, tail)


def with_chi2_p(h: DataFrame) -> DataFrame:
    """Add ``p_value`` to a Kruskal table (NULL without degrees of freedom)."""
    ready = h.withColumn("_x", F.greatest(F.col("h"), F.lit(0.0)))
    ready = ready.withColumn("_root", F.sqrt(F.col("_x") / 2.0)).withColumn("_erfc", erfc(F.col("_root")))
    p = F.when(F.col("h").isNotNull(), chi2_tail(F.col("_x"), F.col("df"), F.col("_erfc")))
    return ready.withColumn("p_value", p).drop("_x", "_root", "_erfc")


def robust_effect(long: DataFrame, label: str, base: str, slices: int = 1) -> DataFrame:
    """(median of a label - median of the base) / IQR of the base, per feature."""
    q = exact_percentiles(long, ["feature", label], {
        "_q1": ("value", 0.25), "_med": ("value", 0.5), "_q3": ("value", 0.75)}, slices)
    ref = q.filter(F.col(label) == base).select(
        "feature", F.col("_med").alias("_base"),
        F.coalesce(F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0)), F.lit(1e-6)).alias("_iqr"))
    return q.filter(F.col(label) != base).join(ref, "feature").select(
        "feature", label, ((F.col("_med") - F.col("_base")) / F.col("_iqr")).alias("effect"))


def describe(long: DataFrame, keys: Sequence[str] = ("feature",), slices: int = 1) -> DataFrame:
    return aggregate(long, keys, [
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")],
        {"p25": ("value", 0.25), "p50": ("value", 0.5), "p75": ("value", 0.75)}, slices)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns, rows with a NULL in the pair ignored.

    One aggregate over the rows; the number of pairs depends on the columns only.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = [
        F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"_{i}")
        for i, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(rows))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Most frequent values (a top-k report)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k)


def quantile_trim(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, slices: int = 1) -> DataFrame:
    bounds = exact_percentiles(df, [], {"_lo": (column, low), "_hi": (column, high)}, slices)
    return df.crossJoin(F.broadcast(bounds)).filter(  # one row
        (F.col(column) >= F.col("_lo")) & (F.col(column) <= F.col("_hi"))).drop("_lo", "_hi")


def ecdf(long: DataFrame, keys: Sequence[str] = ("feature",), slices: int = 1) -> DataFrame:
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    run = Ordered(tuple(keys), ("value",), slices).apply(counts, running={"_upto": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return join_keys(run, totals, keys).select(*keys, "value", (F.col("_upto") / F.col("_total")).alias("ecdf"))


def common_histogram(long: DataFrame, side: str, bins: int = 20, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Counts of several sides over shared equal-width bins."""
    span = long.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    at = F.floor(ratio((F.col("value") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    # one row per feature; a shuffled join would bring all rows of a feature into one task
    return join_keys(long, F.broadcast(span), keys).groupBy(
        *keys, side, F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def event_timeline(events: DataFrame, kinds: Sequence[str], bucket_ms: float = 1000.0) -> DataFrame:
    """Counts per (session, second) with one column per kind."""
    at = F.floor(F.col("t") / F.lit(float(bucket_ms))).alias("second")
    return events.groupBy("session_id", at).pivot("event_type", list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def resample(series: DataFrame, keys: Sequence[str], hz: float) -> DataFrame:
    """Uniform grid by binned mean; empty bins are 0.  Input (keys, s, v), output (keys, i, grid_s, v)."""
    span = series.groupBy(*keys).agg(F.min("s").alias("_s0"), F.max("s").alias("_s1"))
    n = F.greatest(F.lit(2), F.ceil((F.col("_s1") - F.col("_s0")) * hz).cast("int") + 1)
    span = span.withColumn("_n", n)
    at = F.least(F.floor((F.col("s") - F.col("_s0")) * hz).cast("int"), F.col("_n") - 1)
    means = join_keys(series, span, keys).groupBy(*keys, at.alias("i")).agg(F.avg("v").alias("v"))
    # Cells of bounded size, dealt over all tasks, become places there: no array holds a whole session.
    cells = span.select(*keys, "_s0", "_n", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("_n") - 1) / GRID_CELL).cast("int"))).alias("_cell")).repartition(*keys, "_cell")
    grid = cells.select(*keys, "_s0", F.explode(F.sequence(
        F.col("_cell") * GRID_CELL, F.least(F.col("_n"), (F.col("_cell") + 1) * GRID_CELL) - 1)).alias("i"))
    return join_keys(grid, means, [*keys, "i"], "left").select(
        *keys, "i", (F.col("_s0") + F.col("i") / F.lit(float(hz))).alias("grid_s"), F.coalesce("v", F.lit(0.0)).alias("v"))


def identity_schemes(players: DataFrame) -> DataFrame:
    """How a match names its players.  Input (match_id, player)."""
    ids = players.select("match_id", "player").distinct()
    generic = F.col("player").rlike(r"^Player_\d+$")
    steam = F.col("player").rlike(r"^7656119\d{10}$")
    per = ids.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("players"), F.avg(generic.cast("double")).alias("_generic"),
        F.min(steam.cast("int")).alias("_steam"))
    scheme = (F.when(F.col("_steam") == 1, "steam64").when(F.col("_generic") >= 0.8, "generic").otherwise("mixed"))
    return per.select("match_id", "players", scheme.alias("scheme"))


def identity_verdict(players: DataFrame, saturation: int = 16) -> DataFrame:
    """One row: distinct ids over all matches, THIN when they saturate."""
    union = players.select("player").distinct().agg(F.count(F.lit(1)).alias("distinct_players"))
    return union.withColumn("verdict", F.when(F.col("distinct_players") <= saturation, "THIN").otherwise("DIVERSE"))


def player_profiles(features: DataFrame, columns: Sequence[str], by: str = "player") -> DataFrame:
    """(player, feature, mean, scaled, z): min-max and z-score across players."""
    means = features.groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = cut_lineage(means).unpivot([by], list(columns), "feature", "mean")
    across = long.groupBy("feature").agg(
        F.min("mean").alias("_lo"), F.max("mean").alias("_hi"), F.avg("mean").alias("_mu"), F.stddev_samp("mean").alias("_sd"))
    span = F.col("_hi") - F.col("_lo")
    return long.join(across, "feature").select(
        by, "feature", "mean",
        ((F.col("mean") - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span)).alias("scaled"),
        ratio(F.col("mean") - F.col("_mu"), F.col("_sd")).alias("z"))


def session_fingerprint(features: DataFrame, columns: Sequence[str], coverage: float = 0.2, slices: int = 1) -> DataFrame:
    """(session_id, feature, z): session means, columns with enough coverage, median fill."""
    means = features.groupBy("session_id").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = cut_lineage(means).unpivot(["session_id"], list(columns), "feature", "value")
    med = aggregate(long, ["feature"], [F.avg(F.col("value").isNotNull().cast("double")).alias("_cover")],
                    {"_median": ("value", 0.5)}, slices).filter(F.col("_cover") > coverage)
    filled = long.join(med, "feature").withColumn("value", F.coalesce("value", "_median"))
    across = filled.groupBy("feature").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    return filled.join(across, "feature").select(
        "session_id", "feature", ratio(F.col("value") - F.col("_mu"), F.col("_sd")).alias("z"))


def windows_per_fold(features: DataFrame, folds: DataFrame) -> DataFrame:
    return features.join(folds.select("session_id", "fold"), "session_id").groupBy("player", "fold").agg(
        F.count(F.lit(1)).alias("windows"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class), one row per class."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # one row per class
    return sizes.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
