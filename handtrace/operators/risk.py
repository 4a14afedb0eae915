"""Calibration and log-odds combination of detector scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CALIBRATION_FLOOR, LOGIT_FLOOR, PRIOR_RISK
from ..functions.exprs import clip, logit, sigmoid
from ..functions.ordered import Ordered, aggregate, exact_percentiles, join_keys


def fit_isotonic(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Monotone score -> probability knots of one detector, as (x, p) rows.

    MLlib pools the values in a distributed way; only the model's knots are read back.
    """
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(
        scored.select(F.col(score).cast("double"), F.col(label).cast("double")))
    knots = list(zip([float(x) for x in model.boundaries], [float(p) for p in model.predictions]))
    return scored.sparkSession.createDataFrame(knots, "x double, p double")


def fit_isotonic_per_detector(scored: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """(detector, x, p) knots; the loop is over the handful of detector names."""
    out = None
    for name in detectors:
        knots = fit_isotonic(scored.filter(F.col("detector") == name)).withColumn("detector", F.lit(name))
        out = knots if out is None else out.unionByName(knots)
    return out


def apply_isotonic(scored: DataFrame, knots: DataFrame, slices: int = 1) -> DataFrame:
    """Interpolate the knots per detector, clip, 0.5 for a detector without knots.

    Knots and scores are walked together in score order: each score sees the latest
    knot below and the nearest knot above.
    """
    mark = knots.select(
        "detector", F.col("x").alias("score"), F.lit(0).alias("_rank"),
        F.struct("x", "p").alias("_knot"))
    rows = scored.withColumns({"_rank": F.lit(1), "_knot": F.lit(None).cast(mark.schema["_knot"].dataType)})
    line = rows.unionByName(mark, allowMissingColumns=True)
    ident = [c for c in scored.columns if c not in ("detector", "score")]
    up = Ordered(("detector",), ("score", "_rank", *ident), slices).apply(line, last={"_below": F.col("_knot")})
    flipped = up.withColumn("_rank", 1 - F.col("_rank"))  # on equal scores the knot is "above" as well
    both = Ordered(("detector",), ("score", "_rank", *ident), slices, reverse=True).apply(
        flipped, last={"_above": F.col("_knot")})
    lo, hi, s = F.col("_below"), F.col("_above"), F.col("score")
    span = hi["x"] - lo["x"]
    p = (
        F.when(lo.isNull() & hi.isNull(), 0.5).when(lo.isNull(), hi["p"]).when(hi.isNull(), lo["p"])
        .when(span == 0, lo["p"]).otherwise(lo["p"] + (hi["p"] - lo["p"]) * (s - lo["x"]) / span))
    return both.filter("_rank = 0").withColumn(
        "p", F.when(s.isNull(), None).otherwise(clip(p, CALIBRATION_FLOOR, 1 - CALIBRATION_FLOOR))
    ).select(*scored.columns, "p")


def platt(scored: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of the one-feature logistic calibration."""
    from pyspark.ml.classification import LogisticRegression
    vec = VectorAssembler(inputCols=[score], outputCol="_v").transform(
        scored.select(F.col(score).cast("double"), F.col(label).cast("double").alias(label)))
    model = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=50).fit(vec)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(score: Column, slope: float, intercept: float) -> Column:
    return clip(sigmoid(score * slope + intercept), CALIBRATION_FLOOR, 1 - CALIBRATION_FLOOR)


def combined_risk(probabilities: DataFrame, prior: float = PRIOR_RISK, keys: Sequence[str] = ("session_id",),
                  known: Sequence[str] | None = None) -> DataFrame:
    """sigmoid(logit(prior) + sum of detector logits); missing and unknown detectors skipped."""
    usable = probabilities.filter(F.col("p").isNotNull())
    if known is not None:
        usable = usable.filter(F.col("detector").isin(list(known)))
    base = logit(F.lit(prior), LOGIT_FLOOR)
    total = usable.groupBy(*keys).agg(F.sum(logit(F.col("p"), LOGIT_FLOOR)).alias("_sum"))
    everyone = probabilities.select(*keys).distinct()
    return join_keys(everyone, total, keys, "left").select(
        *keys, sigmoid(base + F.coalesce("_sum", F.lit(0.0))).alias("risk"))


def explain_risk(probabilities: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """detector -> log-odds contribution per session (one entry per detector)."""
    return probabilities.filter(F.col("p").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("detector", logit(F.col("p"), LOGIT_FLOOR).alias("log_odds"))))).alias("contributions"))


def session_scores(units: DataFrame, slices: int = 1) -> DataFrame:
    """Roll windows up by maximum and chunks by 95th percentile.

    Input (session_id, detector, grain, score) with grain 'window' or 'chunk'.
    """
    rolled = aggregate(units, ["session_id", "detector", "grain"], [F.max("score").alias("_max")],
                       {"_p95": ("score", 0.95)}, slices)
    return rolled.select(
        "session_id", "detector", F.when(F.col("grain") == "chunk", F.col("_p95")).otherwise(F.col("_max")).alias("score"))


def alternative_rollups(units: DataFrame, k: int, threshold: float, slices: int = 1,
                        keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Mean of the top k scores and share above a threshold per group."""
    ranked = Ordered(tuple(keys), ("score", "unit_idx"), slices, reverse=True).apply(units, position="_at")
    return ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("_at") < k, F.col("score"))).alias("top_mean"),
        F.avg((F.col("score") > threshold).cast("double")).alias("share_above"))


def flag_rates(chunks: DataFrame, p: float = 0.95, slices: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Flag units above the legit percentile; hit and false-flag rate per session.

    Input (session_id, score, contains_cheat); ``by`` names columns with a percentile of their own.
    """
    limit = exact_percentiles(chunks.filter(~F.col("contains_cheat")), list(by), {"_limit": ("score", p)}, slices)
    joined = join_keys(chunks, limit, by) if by else chunks.crossJoin(F.broadcast(limit))  # one row
    flagged = joined.withColumn("_flag", (F.col("score") > F.col("_limit")).cast("double"))
    return flagged.groupBy("session_id", *by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg(F.when(F.col("contains_cheat"), F.col("_flag"))).alias("hit_rate"),
        F.avg(F.when(~F.col("contains_cheat"), F.col("_flag"))).alias("false_flag_rate"))
