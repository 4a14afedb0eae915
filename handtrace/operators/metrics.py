"""Score quality: ranking curves, calibration, verification, classification reports.

Curves are running totals over distinct scores per key; rows are counted per
(key, score) before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import keyed_draws
from ..functions.exprs import ratio
from ..functions.ordered import Ordered, aggregate, join_keys
from ..session import cut_lineage, ship_package
from .stats import mid_ranks


def threshold_counts(scored: DataFrame, keys: Sequence[str], slices: int = 1) -> DataFrame:
    """Per distinct score, descending: running true and false positives.

    Input: ``score`` and boolean ``positive``; output adds ``tp``, ``fp``, ``pos``, ``neg``.
    """
    counts = scored.filter(F.col("score").isNotNull()).groupBy(*keys, "score").agg(
        F.sum(F.col("positive").cast("long")).alias("_p"), F.sum((~F.col("positive")).cast("long")).alias("_n"))
    run = Ordered(tuple(keys), ("score",), slices, reverse=True).apply(
        counts, running={"tp": F.col("_p"), "fp": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    joined = join_keys(run, totals, keys) if keys else run.crossJoin(F.broadcast(totals))
    return joined


def roc_auc(scored: DataFrame, keys: Sequence[str], slices: int = 1) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL with one class only."""
    long = scored.filter(F.col("score").isNotNull()).withColumn("value", F.col("score"))
    ranks = mid_ranks(long, keys, {"_neg": ~F.col("positive"), "_pos": F.col("positive")}, slices)
    s = ranks.groupBy(*keys).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(F.col("_pos") * F.col("_rank")).alias("_r"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return s.select(*keys, "n_pos", "n_neg", ratio(F.col("_r") - p * (p + 1) / 2, p * n).alias("auc"))


def average_precision(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of recall steps times precision over the threshold table."""
    step = ratio(F.col("_p").cast("double"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.groupBy(*keys).agg(F.sum(step).alias("ap"))


def rate_at_fpr(curve: DataFrame, keys: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Best detection rate with FPR within the limit; NULL with one class only."""
    allowed = F.col("fp") <= F.lit(limit) * F.col("neg")
    best = F.max(F.when(allowed, ratio(F.col("tp").cast("double"), F.col("pos"))))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return curve.groupBy(*keys).agg(
        F.when(both, F.coalesce(best, F.lit(0.0))).alias("detection_rate"))


def roc_points(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    return curve.select(
        *keys, "score", ratio(F.col("fp").cast("double"), F.col("neg")).alias("fpr"),
        ratio(F.col("tp").cast("double"), F.col("pos")).alias("tpr"))


def pr_points(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    return curve.select(
        *keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ratio(F.col("tp").cast("double"), F.col("pos")).alias("recall"))


def det_points(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False accepts and false rejects when accepting ``score >= threshold``.

    Of the lowest thresholds, which reject no genuine score, only the highest stays; of
    the highest ones, which share the fewest false accepts, only the lowest.
    """
    far = ratio(F.col("fp").cast("double"), F.col("neg"))
    frr = ratio((F.col("pos") - F.col("tp")).cast("double"), F.col("pos"))
    pts = curve.withColumnRenamed("score", "threshold").withColumns({"far": far, "frr": frr})
    ends = pts.groupBy(*keys).agg(
        F.max(F.when(F.col("tp") == F.col("pos"), F.col("threshold"))).alias("_from"),
        F.min(F.struct("fp", "threshold"))["threshold"].alias("_to"))
    joined = join_keys(pts, ends, keys) if keys else pts.crossJoin(F.broadcast(ends))  # one row
    inside = (F.col("threshold") >= F.col("_from")) & (F.col("threshold") <= F.col("_to"))
    return joined.filter(inside).select(*keys, "threshold", "far", "frr")


def equal_error_rate(det: DataFrame, keys: Sequence[str], slices: int = 1) -> DataFrame:
    """EER by interpolation at the first sign change of far - frr, else the nearest point."""
    diff = det.withColumn("_d", F.col("far") - F.col("frr"))
    by = Ordered(tuple(keys), ("threshold",), slices, reverse=True)
    nxt = by.apply(diff, lag={"_d1": "_d", "_far1": "far", "_thr1": "threshold"})
    change = F.col("_d1").isNotNull() & (F.signum("_d1") != F.signum("_d"))
    w = F.when(F.col("_d1") == F.col("_d"), 0.0).otherwise(-F.col("_d") / (F.col("_d1") - F.col("_d")))
    cross = F.struct(
        (F.col("far") + w * (F.col("_far1") - F.col("far"))).alias("eer"),
        (F.col("threshold") + w * (F.col("_thr1") - F.col("threshold"))).alias("thr"))
    nearest = F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), F.col("threshold").alias("thr"))
    picked = nxt.groupBy(*keys).agg(
        F.min_by(F.when(change, cross), F.when(change, F.col("threshold"))).alias("_cross"),
        F.min_by(nearest, F.struct(F.abs("_d"), F.col("threshold"))).alias("_near"))
    best = F.coalesce("_cross", "_near")
    return picked.select(*keys, best["eer"].alias("eer"), best["thr"].alias("threshold"))


def far_at_frr(det: DataFrame, keys: Sequence[str], target: float = 0.05) -> DataFrame:
    """Lowest false-accept rate with false rejects within the target, else 1."""
    return det.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("frr") <= target, F.col("far"))), F.lit(1.0)).alias("far_at_frr"))


def verification_trials(predictions: DataFrame, truth: str, proba: str = "proba") -> DataFrame:
    """One trial per (row, enrolled class): score and whether it is the true class.

    ``proba`` is a map class -> probability, so the fan-out is the number of classes.
    """
    return predictions.select("*", F.explode(proba).alias("claimed", "score")).withColumn(
        "positive", F.col("claimed") == F.col(truth))


def session_trials(predictions: DataFrame, truth: str, classes: Sequence[str], proba: str = "proba") -> DataFrame:
    """(session_id, claimed, score, positive): mean claimed-class probability per session and class.

    Probability vectors are averaged per session first; only sessions, not their rows, are spread by class.
    """
    vector = array_to_vector(F.array(*[F.coalesce(F.col(proba)[c], F.lit(0.0)).cast("double") for c in classes]))
    means = predictions.select("session_id", F.col(truth).alias("_t"), vector.alias("_v")).groupBy("session_id").agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"), F.collect_set("_t").alias("_truths"))
    named = F.explode(F.map_from_arrays(F.array(*map(F.lit, classes)), F.col("_m")))
    return means.select("session_id", "_truths", named.alias("claimed", "score")).select(
        "session_id", "claimed", "score", F.array_contains("_truths", F.col("claimed")).alias("positive"))


def vector_means(vectors: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean vector per group, combined map-side as vectors."""
    ready = vectors.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return ready.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def confusion_counts(predictions: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """One row per true class, one zero-filled column per class."""
    spine = predictions.sparkSession.createDataFrame([(c,) for c in classes], f"{truth} string")
    grid = predictions.groupBy(truth).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return spine.join(grid, truth, "left").na.fill(0)


def classification_report(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (0 where undefined)."""
    counts = confusion_counts(predictions, truth, predicted)
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    by_truth = counts.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = counts.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("claimed"))
    per = by_truth.join(by_pred, "c", "left").withColumns({
        "p": F.coalesce(ratio(F.col("tp").cast("double"), F.col("claimed")), F.lit(0.0)),
        "rc": F.coalesce(ratio(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))})
    f1 = F.coalesce(ratio(2 * F.col("p") * F.col("rc"), F.col("p") + F.col("rc")), F.lit(0.0))
    weighted = lambda e: F.sum(e * F.col("support")) / F.sum("support")
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), weighted(F.col("p")).alias("precision_weighted"),
        weighted(F.col("rc")).alias("recall_weighted"), weighted(f1).alias("f1_weighted"), F.sum("support").alias("n"))


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))


def anomaly_summary(scores: DataFrame, score: str, outlier: Column, keys: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.avg(outlier.cast("double")).alias("outlier_share"))


def reliability_curve(rows: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Equal-width confidence bins; empty ones stay with NULL means."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = rows.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(got, "bin", "left").select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), F.coalesce("_n", F.lit(0)).alias("n"), "confidence", "accuracy")


def expected_calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg(
        ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"))


def brier(predictions: DataFrame, truth: str, proba: str = "proba") -> DataFrame:
    """Mean over rows of the squared distance to the one-hot truth."""
    hot = lambda k: F.when(k == F.col(truth), 1.0).otherwise(0.0)
    row = F.aggregate(F.map_entries(proba), F.lit(0.0), lambda acc, e: acc + F.pow(e["value"] - hot(e["key"]), F.lit(2)))
    return predictions.agg(F.avg(row).alias("brier"))


PLACES = 2 ** 15  # places of a block of rows, and rows of a block of scores
DRAWS_AT_ONCE = 50
TILE = 2 ** 11  # places drawn from in one step


def _grouped(rows: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    """``grp``, the values of ``by`` in one string (NULL keys are kept), and the columns."""
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    return cut_lineage(rows.select(name.alias("grp"), *by, *columns))


def _split(values: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of every part number."""
    order = np.argsort(parts.astype(np.int32), kind="stable")
    ordered = parts[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else []
    for a, b in zip(first, [*first[1:], len(ordered)]):
        yield int(ordered[a]), values[order[a:b]]


def _picks(sizes: DataFrame, draws: int) -> DataFrame:
    """(n, block, chunk, picks): for every distinct group size, the places that the draws pick, md5 mod n.

    A row holds what one tile of draws and places picks in one block, as draw * PLACES + place in the block.
    """
    tiles = sizes.select("n").distinct().select(
        "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TILE).cast("long"))).alias("low")).select(
        "n", "low", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_AT_ONCE))).alias("chunk"))
    cores, n_tiles = sizes.sparkSession.sparkContext.defaultParallelism, tiles.count()
    spread = tiles.repartition(max(1, min(n_tiles, max(3 * cores, n_tiles // 64))), "n", "low", "chunk")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, low, chunk in frame.itertuples(index=False):
                drawn = keyed_draws(range(chunk, min(chunk + DRAWS_AT_ONCE, draws)), range(low, min(low + TILE, n)))
                at = (drawn % np.uint64(n)).astype(np.int64)
                packed = (np.arange(len(at))[:, None] * PLACES + at % PLACES).astype(np.int32)
                rows = [(n, b, chunk, part.tobytes()) for b, part in _split(packed.ravel(), at.ravel() // PLACES)]
                yield pd.DataFrame(rows, columns=["n", "block", "chunk", "picks"])

    return spread.mapInPandas(pick, "n long, block long, chunk int, picks binary")


def _resampled(rows: DataFrame, draws: int, ident: str, slices: int, pack: Callable[[pd.DataFrame], tuple], packed: str,
               count: Callable[..., pd.DataFrame], counted: str) -> DataFrame:
    """What ``count`` makes of the picks of a chunk of draws in a block of a group's rows.

    ``pack`` turns the rows of a block, in place order, into the columns ``packed``; ``count`` gets the chunk's
    draws and places in the block, and these columns. Places are drawn once for all groups of one size, and meet
    the rows in blocks of bounded size: no row is copied per draw.
    """
    ship_package(rows.sparkSession)
    names = [c.split(" ")[0] for c in packed.split(", ")]
    numbered = Ordered(("grp",), (ident,), slices).apply(rows, position="at")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    placed = join_keys(numbered, sizes, ["grp"]).withColumn("block", F.floor(F.col("at") / PLACES))

    def pack_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *pack(block.sort_values("at")))], columns=["grp", "n", "block", *names])

    def count_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        picks = np.frombuffer(b"".join(group["picks"].dropna()), dtype=np.int32)
        blocks = group[group["picks"].isna()]
        return pd.concat([
            count(*values, picks // PLACES, picks % PLACES).assign(grp=grp, chunk=key[2])
            for grp, *values in zip(blocks["grp"], *[blocks[c] for c in names])], ignore_index=True)

    blocks = placed.groupBy("grp", "n", "block").applyInPandas(pack_block, f"grp string, n long, block long, {packed}")
    spread = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_AT_ONCE))))
    return spread.unionByName(_picks(sizes, draws), allowMissingColumns=True).groupBy("n", "block", "chunk").applyInPandas(
        count_block, f"grp string, chunk int, {counted}")


def _interval(per: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return aggregate(per, list(by), [F.count(F.lit(1)).alias("draws"), F.avg(value).alias("mean")],
                     {"low": (value, 0.025), "high": (value, 0.975)}, 1)


def bootstrap(predictions: DataFrame, draws: int, truth: str, predicted: str, ident: str, by: Sequence[str] = (),
              slices: int = 1) -> DataFrame:
    """(by, metric, draws, mean, low, high): percentile intervals of accuracy and macro F1.

    Picks are counted per (draw, truth, prediction) at once, so everything after the draw works on one
    confusion table per draw. F1 is taken over the classes that a draw holds as truth or prediction.
    """
    keys = [*by, "draw"]
    pair = F.struct(F.col(truth).alias("_t"), F.col(predicted).alias("_p"))
    rows = _grouped(predictions, by, F.col(ident), pair.alias("pair"), F.to_json(pair, {"ignoreNullFields": "false"}).alias("cell"))

    def pack(block: pd.DataFrame) -> tuple:
        cells, codes = np.unique(block["cell"].to_numpy(str), return_inverse=True)
        return cells.tolist(), codes.astype(np.int32).tobytes()

    def count(cells: Sequence[str], codes: bytes, draw: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        found = np.bincount(draw * len(cells) + np.frombuffer(codes, dtype=np.int32)[place])
        some = np.flatnonzero(found)
        return pd.DataFrame({"draw": some // len(cells), "cell": np.asarray(cells)[some % len(cells)], "n": found[some]})

    picked = _resampled(rows, draws, ident, slices, pack, "cells array<string>, codes binary", count, "draw int, cell string, n long")
    known = rows.select("grp", *by, "cell", "pair").distinct()
    cells = picked.withColumn("draw", F.col("chunk") + F.col("draw")).groupBy("grp", "draw", "cell").agg(
        F.sum("n").alias("n")).join(known, ["grp", "cell"]).select(*keys, "pair.*", "n")
    hit = F.when(F.col("_t").eqNullSafe(F.col("_p")), F.col("n")).otherwise(0)
    sides = F.inline(F.array(
        F.struct(F.col("_t").alias("cls"), F.col("n").alias("side"), hit.alias("hit")),
        F.struct(F.col("_p").alias("cls"), F.col("n").alias("side"), F.lit(0).cast("long").alias("hit"))))
    classes = cells.select(*keys, sides).groupBy(*keys, "cls").agg(
        F.sum("hit").alias("hit"), F.sum("side").alias("sides"))
    per = classes.groupBy(*keys).agg(
        (F.sum("hit") / (F.sum("sides") / 2)).alias("accuracy"), F.avg(2 * F.col("hit") / F.col("sides")).alias("macro_f1"))
    long = per.unpivot(keys, ["accuracy", "macro_f1"], "metric", "value")
    return _interval(long, [*by, "metric"], "value")


def bootstrap_auc(scored: DataFrame, draws: int, ident: str, by: Sequence[str] = (), slices: int = 1) -> DataFrame:
    """(by, draws, mean, low, high) of the AUC; draws with one class only are skipped.

    Scores are cut into blocks of about ``PLACES`` rows that never part equal scores. Picks are counted per score
    and class inside their block; between blocks only the number of negatives below counts.
    """
    rows = _grouped(scored, by, F.col(ident), F.col("score"), F.col("positive"))
    known = rows.where(F.col("score").isNotNull())
    run = Ordered(("grp",), ("score",), slices).apply(
        known.groupBy("grp", "score").agg(F.count(F.lit(1)).alias("_rows")), running={"_upto": F.col("_rows")})
    step = run.select("grp", "score", F.floor((F.col("_upto") - F.col("_rows")) / PLACES).alias("range"))
    step = Ordered(("grp", "range"), ("score",), 1).apply(step, position="_step")  # PLACES scores at most
    code = F.when(F.col("positive").isNotNull(), 2 * F.col("_step") + F.col("positive").cast("int"))
    coded = join_keys(rows, step, ["grp", "score"], "left").select(
        "grp", *by, ident, F.coalesce(F.when(code.isNotNull(), F.col("range")), F.lit(-1)).alias("range"),
        F.coalesce(code, F.lit(0)).alias("code"))

    def pack(block: pd.DataFrame) -> tuple:
        return tuple(block[c].to_numpy(np.int32).tobytes() for c in ("range", "code"))

    def count(ranges: bytes, codes: bytes, draw: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        drawn = draw * (2 * PLACES) + np.frombuffer(codes, dtype=np.int32)[place]
        out = []
        for at, part in _split(drawn, np.frombuffer(ranges, dtype=np.int32)[place]):
            if at >= 0:
                some, n = np.unique(part, return_counts=True)
                few = 2 * len(some) <= len(part)  # otherwise the picks themselves are shorter than their counts
                out.append((at, (some if few else part).tobytes(), n.astype(np.int32).tobytes() if few else None))
        return pd.DataFrame(out, columns=["range", "drawn", "times"])

    def wins(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(DRAWS_AT_ONCE * 2 * PLACES, dtype=np.int64)
        for drawn, times in zip(group["drawn"], group["times"]):
            some = np.frombuffer(drawn, dtype=np.int32)
            if times is None:
                table += np.bincount(some, minlength=len(table))
            else:
                table[some] += np.frombuffer(times, dtype=np.int32)
        table = table.reshape(DRAWS_AT_ONCE, PLACES, 2)
        neg, pos = table[:, :, 0], table[:, :, 1]
        return pd.DataFrame({
            "grp": key[0], "range": key[1], "draw": key[2] + np.arange(DRAWS_AT_ONCE), "pos": pos.sum(axis=1),
            "neg": neg.sum(axis=1), "twice": (pos * (2 * neg.cumsum(axis=1) - neg)).sum(axis=1)})

    counts = _resampled(coded, draws, ident, slices, pack, "ranges binary, codes binary", count,
                        "range long, drawn binary, times binary")
    parts = counts.groupBy("grp", "range", "chunk").applyInPandas(
        wins, "grp string, range long, draw int, pos long, neg long, twice long")
    below = F.coalesce(F.sum("neg").over(
        Window.partitionBy("grp", "draw").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = parts.where(F.col("draw") < draws).withColumn("_below", below).groupBy("grp", "draw").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("twice") + 2 * F.col("pos") * F.col("_below")).alias("twice"))
    auc = ratio(F.col("twice") / 2.0, F.col("pos").cast("double") * F.col("neg"))
    named = per.select("grp", auc.alias("auc")).where(F.col("auc").isNotNull()).join(rows.select("grp", *by).distinct(), "grp")
    return _interval(named, by, "auc")


def benchmark_grid(scores: DataFrame, negative: str = "legit", slices: int = 1) -> DataFrame:
    """detector x label: every label against the shared negatives of its detector.

    Input (detector, label, score). One relation holds, per detector and score, how many negatives lie below
    and above; the labels' own counts meet it, so negatives are never copied. Rank sums, precision at hits and
    the best rate within a false-positive limit only change at scores of a label's own rows.
    """
    keys = ["detector", "label"]
    known = scores.filter(F.col("score").isNotNull())
    is_negative = F.col("label") == negative
    counts = cut_lineage(known.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_p")))
    every = counts.groupBy("detector", "score").agg(F.sum(F.when(is_negative, F.col("_p")).otherwise(0)).alias("_n"))
    every = Ordered(("detector",), ("score",), slices, reverse=True).apply(every, running={"fp": F.col("_n")})
    negatives = counts.where(is_negative).groupBy("detector").agg(
        F.sum("_p").alias("neg"), (F.sum(F.col("score") * F.col("_p")) / F.sum("_p")).alias("mean_legit"))
    own = Ordered(tuple(keys), ("score",), slices, reverse=True).apply(
        counts.where(~is_negative), running={"tp": F.col("_p")})
    sizes = counts.where(~is_negative).groupBy(*keys).agg(F.sum("_p").alias("pos"))
    curve = join_keys(join_keys(join_keys(own, every, ["detector", "score"]), negatives, ["detector"], "left"), sizes, keys)
    curve = curve.withColumn("neg", F.coalesce("neg", F.lit(0)))
    below = F.col("neg") - F.col("fp") + F.col("_n") / 2.0
    points = curve.groupBy(*keys, "pos", "neg", "mean_legit").agg(
        F.sum(F.col("_p") * below).alias("_wins"),
        F.sum(ratio(F.col("_p").cast("double"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.max(F.when(F.col("fp") <= F.lit(0.05) * F.col("neg"), F.col("tp") / F.col("pos"))).alias("_best"),
        (F.sum(F.col("score") * F.col("_p")) / F.sum("_p")).alias("mean_cheat"))
    return points.select(
        *keys, F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"),
        ratio(F.col("_wins"), F.col("pos").cast("double") * F.col("neg")).alias("auc"), "ap",
        F.when(F.col("neg") > 0, F.coalesce("_best", F.lit(0.0))).alias("detection_rate"), "mean_cheat", "mean_legit")


def benchmark_pivot(grid: DataFrame, labels: Sequence[str], value: str = "auc") -> DataFrame:
    return grid.groupBy("detector").pivot("label", list(labels)).agg(F.first(value))


def heldout_benchmark(scores: DataFrame, splits: DataFrame, slices: int = 1) -> DataFrame:
    """Mean AUC, 95 % range and median test size over repeated held-out groups.

    ``scores``: (group_id, detector, score, positive); ``splits``: (repeat, group_id, held_out).
    """
    test = scores.join(splits.filter("held_out").select("repeat", "group_id"), "group_id")
    each = roc_auc(test, ["detector", "repeat"], slices).withColumn("n_test", F.col("n_pos") + F.col("n_neg"))
    return aggregate(each, ["detector"], [F.avg("auc").alias("auc_mean"), F.count("auc").alias("repeats")],
                     {"auc_low": ("auc", 0.025), "auc_high": ("auc", 0.975), "median_test": ("n_test", 0.5)}, 1)


def best_run(runs: DataFrame, metric: str, order: str) -> DataFrame:
    """Run with the highest metric, the earliest on ties."""
    return runs.agg(F.max_by("run_id", F.struct(F.col(metric), -F.col(order))).alias("run_id"), F.max(metric).alias(metric))


def budget_curve(runs: DataFrame) -> DataFrame:
    return runs.groupBy("init", "budget").agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count(F.lit(1)).alias("runs"))


def frontier(runs: DataFrame, utility_limit: float = 0.2) -> DataFrame:
    """AUC per (cheat, lambda) and the smallest lambda with utility within the limit."""
    per = runs.groupBy("cheat", "lambda").agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("utility").alias("utility"))
    cut = per.filter(F.col("utility") <= utility_limit).groupBy("cheat").agg(F.min("lambda").alias("break_lambda"))
    return per.join(cut, "cheat", "left")
