"""Leakage-free splits and repeatable sampling.

Random choice is the rank of md5(seed | id): independent of partitioning, identical
after a lost executor, and reproducible by plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hashed
from ..functions.ordered import Ordered, group_extent, join_keys
from ..session import cut_lineage


def _ranked(df: DataFrame, keys: Sequence[str], ident: str, seed: Column | int, slices: int) -> DataFrame:
    """``_at``: rank of the row in its group by keyed hash; ``_n``: group size."""
    drawn = df.withColumn("_draw", hashed(F.lit(seed) if isinstance(seed, int) else seed, F.col(ident)))
    ranked = Ordered(tuple(keys), ("_draw", ident), slices).apply(drawn, position="_at")
    return group_extent(ranked, list(keys), {"_n": F.count(F.lit(1))}, slices).drop("_draw")


def _part_of(n: Column, share: float) -> Column:
    """Whole rows in a share of ``n``; decimal, as binary 0.7 * 90 falls short of 63."""
    return F.floor(n * F.lit(Decimal(str(share))))


def stratified_sessions(
    sessions: DataFrame, test_size: float, val_size: float, min_sessions: int,
    seed: int = 42, slices: int = 1,
) -> DataFrame:
    """(session_id, player, fold): whole sessions, every player in each non-empty fold.

    Cheat sessions and players with too few sessions are left out.  Sizes per player of
    n sessions: round-half-even of the share, at least one once n allows; validation,
    then test, shrink until training keeps one.
    """
    legit = sessions.filter(~F.coalesce("is_cheat_session", F.lit(False))).select("session_id", "player")
    ranked = _ranked(legit, ["player"], "session_id", seed, slices).filter(F.col("_n") >= min_sessions)
    n = F.col("_n")
    share = lambda p: F.greatest(F.lit(1), F.bround(n * F.lit(float(p))).cast("long"))
    test, val = F.when(n >= 2, share(test_size)).otherwise(0), F.when(n >= 3, share(val_size)).otherwise(0)
    sized = ranked.withColumns({"_test": test, "_val": val})
    excess = F.greatest(F.lit(0), F.col("_test") + F.col("_val") - (n - 1))
    sized = sized.withColumn("_excess", excess)
    from_val = F.least(F.col("_val"), F.col("_excess"))
    sized = sized.withColumns({
        "_val": F.col("_val") - from_val,
        "_test": F.greatest(F.lit(0), F.col("_test") - (F.col("_excess") - from_val))})
    fold = (
        F.when(F.col("_at") < F.col("_test"), "test")
        .when(F.col("_at") < F.col("_test") + F.col("_val"), "val")
        .otherwise("train"))
    return sized.select("session_id", "player", fold.alias("fold"))


def leaking_sessions(assigned: DataFrame) -> DataFrame:
    """Sessions present in more than one fold; must be empty."""
    return assigned.groupBy("session_id").agg(F.count_distinct("fold").alias("folds")).filter("folds > 1")


def repeated_holdout(groups: DataFrame, repeats: int, share: float = 0.4, seed: int = 0, slices: int = 1) -> DataFrame:
    """(repeat, group_id, held_out) for ``repeats`` independent draws over group ids."""
    each = groups.select("group_id").distinct().withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seeded = F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"))
    ranked = _ranked(each, ["repeat"], "group_id", seeded, slices)
    held = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("long"))
    return ranked.select("repeat", "group_id", (F.col("_at") < held).alias("held_out"))


def stratified_half(rows: DataFrame, label: str, ident: str, seed: int = 0, slices: int = 1) -> DataFrame:
    """Half of each label for fitting, the rest for testing."""
    ranked = _ranked(rows, [label], ident, seed, slices)
    half = F.floor(F.col("_n") / 2)
    return ranked.withColumn("part", F.when(F.col("_at") < half, "fit").otherwise("test")).drop("_at", "_n")


def last_share(sessions: DataFrame, by: str, share: float = 0.2, slices: int = 1) -> DataFrame:
    """Last ``share`` (at least one) of each user's sessions in id order is test."""
    ranked = Ordered((by,), ("session_id",), 1).apply(sessions, position="_at") if slices <= 1 else \
        _positions_by_text(sessions, by, slices)
    sized = group_extent(ranked, [by], {"_n": F.count(F.lit(1))}, slices)
    held = F.greatest(F.lit(1), _part_of(F.col("_n"), share))
    return sized.withColumn(
        "part", F.when(F.col("_at") >= F.col("_n") - held, "test").otherwise("train")).drop("_at", "_n")


def _positions_by_text(sessions: DataFrame, by: str, slices: int) -> DataFrame:
    """Positions in the order of whole ids of an oversized group: runs are ranges of (group, id)."""
    ranged = sessions.repartitionByRange(2 * slices, by, "session_id").withColumn("_slice", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy(by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_row", F.row_number().over(Window.partitionBy(by, "_slice").orderBy("session_id")))
    joined = join_keys(local, sizes, [by, "_slice"], "left")
    return joined.withColumn("_at", (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_slice", "_row", "_before")


def temporal_split(rows: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = 0.7,
                   gap: int = 1, slices: int = 1) -> DataFrame:
    """Earlier ``share`` of a group trains, later rows test, ``gap`` rows between are dropped."""
    ranked = Ordered(tuple(keys), tuple(order), slices).apply(rows, position="_at")
    sized = group_extent(ranked, list(keys), {"_n": F.count(F.lit(1))}, slices)
    cut = _part_of(F.col("_n"), share)
    part = F.when(F.col("_at") < cut, "train").when(F.col("_at") >= cut + gap, "test")
    return sized.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_at", "_n")


def protocol_split(rows: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Three-minute recordings train, one-minute recordings test."""
    part = F.when(F.col(protocol) == "3min", "train").when(F.col(protocol) == "1min", "test")
    return rows.withColumn("part", part).filter(F.col("part").isNotNull())


def disjoint_manifest(ids: DataFrame, ident: str, shares: tuple[float, float] = (0.8, 0.1),
                      subsets: Sequence[int] = (50, 200), seed: int = 42, slices: int = 1) -> DataFrame:
    """(id, rank, fold, subset_k...) with nested training subsets (rank below k)."""
    ranked = _ranked(ids.select(ident).distinct(), [], ident, seed, slices)
    n = F.col("_n")
    train, val = _part_of(n, shares[0]), _part_of(n, round(shares[0] + shares[1], 12))
    fold = F.when(F.col("_at") < train, "train").when(F.col("_at") < val, "val").otherwise("test")
    named = ranked.withColumn("fold", fold)
    for k in subsets:
        named = named.withColumn(f"subset_{k}", (F.col("fold") == "train") & (F.col("_at") < k))
    return named.withColumnRenamed("_at", "rank").drop("_n")


def random_subsets(ids: DataFrame, ident: str, size: int, draws: int, seed: int = 0, slices: int = 1) -> DataFrame:
    """(draw, id): ``draws`` subsets of ``size`` ids."""
    each = ids.select(ident).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    seeded = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))
    return _ranked(each, ["draw"], ident, seeded, slices).filter(F.col("_at") < size).select("draw", ident)


def open_set(ids: DataFrame, ident: str, seed: int = 0, slices: int = 1) -> DataFrame:
    """(id, enrolled): half of the users is known, the other half is not."""
    ranked = _ranked(ids.select(ident).distinct(), [], ident, seed, slices)
    return ranked.select(ident, (F.col("_at") < F.floor(F.col("_n") / 2)).alias("enrolled"))


def held_out_ids(ids: DataFrame, ident: str, share: float, seed: int = 0, slices: int = 1) -> DataFrame:
    """(id, part): a share of the players never seen in training."""
    ranked = _ranked(ids.select(ident).distinct(), [], ident, seed, slices)
    held = F.greatest(F.lit(1), _part_of(F.col("_n"), share))
    return ranked.select(ident, F.when(F.col("_at") < held, "test").otherwise("train").alias("part"))


def bounded_sample(rows: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with the smallest keyed hash (a distributed top-n)."""
    return rows.orderBy(hashed(seed, F.col(ident)), ident).limit(n)


def balanced_first(rows: DataFrame, label: str, order: str, n: int, slices: int = 1) -> DataFrame:
    """First ``n`` rows per class."""
    ranked = Ordered((label,), (order,), slices).apply(rows, position="_at")
    return ranked.filter(F.col("_at") < n).drop("_at")
