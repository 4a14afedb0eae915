"""Identification and anomaly models on MLlib, and exact distributed neighbours.

Only fitted parameters (coefficients, components, tree nodes) ever reach the driver;
their size depends on features, classes and trees, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..constants import STD_FLOOR
from ..functions.exprs import hashed, ratio, uniform
from ..functions.ordered import Ordered

CLASSES_AT_ONCE = 8  # classes fitted side by side: a pass over the rows is too short to fill a cluster


# ---------------------------------------------------------------- preparation
def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL -> 0 in the model inputs."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def scale_like(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Z-score with the training mean and population std (one broadcast row)."""
    stats = filled(train, features).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    spread = lambda c: F.when(F.col(f"_s_{c}") < STD_FLOOR, 1.0).otherwise(F.col(f"_s_{c}"))
    return filled(df, features).crossJoin(F.broadcast(stats)).withColumns(
        {c: (F.col(c) - F.col(f"_m_{c}")) / spread(c) for c in features}).select(*df.columns)


def with_balance(df: DataFrame, label: str, spread: bool = True) -> DataFrame:
    """Row weight n / (classes * n_class).

    ``spread``: the class table goes to the rows, which stay dealt as they are; else Spark picks the join, which
    can gather each class in one task.
    """
    from .stats import class_weights
    weights = class_weights(df, label).select(label, F.col("weight"))
    return df.join(F.broadcast(weights) if spread else weights, label)


# ---------------------------------------------------------------- identification
def _estimator(kind: str, seed: int):
    common = dict(featuresCol="features", labelCol="y")
    if kind == "forest":
        return RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=6, seed=seed, **common)
    base = {
        "boosted": GBTClassifier(maxIter=5, maxDepth=3, seed=seed),
        "linear_svc": LinearSVC(maxIter=20), "logistic": LogisticRegression(maxIter=20)}[kind]
    return OneVsRest(classifier=base, weightCol="weight", parallelism=CLASSES_AT_ONCE, **common)


def fit_identifier(train: DataFrame, features: Sequence[str], label: str = "player", kind: str = "forest",
                   seed: int = 7) -> PipelineModel | None:
    """Class-balanced identifier; None when fewer than two classes exist."""
    if train.select(label).distinct().limit(2).count() < 2:
        return None
    steps = [
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=list(features), outputCol="features"), _estimator(kind, seed)]
    draws = kind in ("forest", "boosted")  # MLlib draws bags and split candidates by task: their rows stay dealt by class
    rows = with_balance(filled(train.select(label, *features), features), label, not draws).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:  # iterative trainers read the rows once per pass
        return Pipeline(stages=steps).fit(rows)
    finally:
        rows.unpersist()


def identify(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with ``y_pred`` and, where the model has them, class probabilities as a map."""
    names = model.stages[0].labels
    ready = model.stages[1].transform(filled(df, features))
    scored = model.stages[2].transform(ready)
    classes = F.array(*[F.lit(n) for n in names])
    out = scored.withColumn("y_pred", F.element_at(classes, (F.col("prediction") + 1).cast("int")))
    if "probability" in scored.columns:
        out = out.withColumn("proba", F.map_from_arrays(classes, vector_to_array("probability")))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def score_windows(model: PipelineModel, train: DataFrame, df: DataFrame, features: Sequence[str], ident: str,
                  contamination: float = 0.05, trees: int = 50, seed: int = 0) -> DataFrame:
    """Rows of ``df`` with ``y_pred``, ``proba`` (class map), ``anomaly_score`` and ``is_anomaly``.

    The isolation forest grows on the scaled training rows; a row is anomalous if its score lies above
    the ``1 - contamination`` percentile of theirs.  ``ident`` numbers the rows of both tables.
    """
    from ..functions.ordered import exact_percentiles, slices_for
    columns = list(features)
    parts = [scale_like(train, d, columns).select(F.col(ident), F.array(*columns).alias("_v")) for d in (train, df)]
    both = parts[0].withColumn("_fit", F.lit(True)).unionByName(parts[1].withColumn("_fit", F.lit(False)))
    scored = isolation_forest(parts[0], both, ident, "_v", trees, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    known = scored.where("_fit")
    limit = exact_percentiles(known, [], {"_limit": ("score", 1 - contamination)}, slices_for(known.count()))
    flagged = scored.where("not _fit").crossJoin(F.broadcast(limit)).select(  # one row
        ident, F.col("score").alias("anomaly_score"), (F.col("score") > F.col("_limit")).alias("is_anomaly"))
    return identify(model, df, columns).join(flagged, ident)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    from pyspark.sql import SparkSession
    values = model.stages[2].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


def permute_column(df: DataFrame, column: str, ident: str, seed: int, slices: int = 1) -> DataFrame:
    """Shuffle one column: rows in id order receive the values in keyed-hash order."""
    ranked = Ordered((), (ident,), slices).apply(df.withColumn("_h", hashed(seed, F.col(ident))), position="_to")
    values = Ordered((), ("_h", ident), slices).apply(
        df.select(ident, column).withColumn("_h", hashed(seed, F.col(ident))), position="_to")
    return ranked.drop(column, "_h").join(values.select("_to", column), "_to").drop("_to").select(*df.columns)


# ---------------------------------------------------------------- projections
def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def fit_projection(df: DataFrame, k: int, vector: str = "features"):
    """(PCA model, mean vector) of the rows."""
    model = PCA(k=k, inputCol=vector, outputCol="projected").fit(df)
    mean = df.agg(Summarizer.mean(F.col(vector)).alias("m")).first()["m"].toArray()
    return model, mean


def embed(df: DataFrame, model, mean: np.ndarray, out: str = "embedding") -> DataFrame:
    """Centred projection as an array column."""
    shift = [float(x) for x in mean @ model.pc.toArray()]
    centre = F.array(*[F.lit(x) for x in shift])
    projected = vector_to_array("projected")
    return model.transform(df).withColumn(out, F.zip_with(projected, centre, lambda p, c: p - c)).drop("projected")


def reconstruction_error(df: DataFrame, model, mean: np.ndarray, array: str = "v", out: str = "score") -> DataFrame:
    """Mean squared error of the rank-k reconstruction.

    The components are orthonormal, so the error is the squared length that the
    projection loses; nothing is reconstructed.
    """
    centre = F.array(*[F.lit(float(x)) for x in mean])
    square = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)
    whole = square(F.zip_with(F.col(array), centre, lambda x, c: x - c))
    kept = square(F.col("_e"))
    return embed(df, model, mean, "_e").withColumn(
        out, F.greatest(F.lit(0.0), whole - kept) / F.lit(float(len(mean)))).drop("_e")


def channel_errors(df: DataFrame, model, mean: np.ndarray, channels: int, array: str = "v") -> DataFrame:
    """(group columns.., channel, error): mean squared residual per channel and label."""
    basis, centre = model.pc.toArray(), np.asarray(mean)

    @F.pandas_udf("array<double>")
    def per_channel(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()) - centre
        residual = (x - (x @ basis) @ basis.T) ** 2
        return pd.Series(list(residual.reshape(len(x), -1, channels).mean(axis=1)))

    errors = df.select("label", F.posexplode(per_channel(array)).alias("channel", "error"))
    return errors.groupBy("label", "channel").agg(F.avg("error").alias("error"))


def loadings(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """(component, feature, loading, rank) of the leading components."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(filled(df, features))
    model, _ = fit_projection(vec, k)
    pc = model.pc.toArray()
    rows = [(c, f, float(pc[i, c])) for c in range(k) for i, f in enumerate(features)]
    table = df.sparkSession.createDataFrame(rows, "component int, feature string, loading double")
    return Ordered(("component",), ("_s", "feature"), 1).apply(
        table.withColumn("_s", -F.abs("loading")), position="rank").drop("_s")


def mahalanobis(train: DataFrame, df: DataFrame, vector: str = "features", shrink: float = 0.1, out: str = "score") -> DataFrame:
    """Squared distance under the shrunk covariance (1-s)C + s tr(C)/d I.

    Shrinking keeps the eigenvectors, so a full PCA of C gives the whitening.
    """
    d = len(train.select(vector).first()[0])
    model, mean = fit_projection(train, d, vector)
    total = train.agg(Summarizer.variance(F.col(vector)).alias("v")).first()["v"].toArray().sum()
    spread = (1 - shrink) * model.explainedVariance.toArray() * total + shrink * total / d
    scale = F.array(*[F.lit(float(1 / s)) for s in spread])
    weighted = F.zip_with("_e", scale, lambda e, s: e * e * s)
    return embed(df, model, mean, "_e").withColumn(out, F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)).drop("_e")


# ---------------------------------------------------------------- neighbours
BLOCK_ROWS = 8_000
QUERY_ROWS = 256  # queries of one matrix product
PAIRS = 2 ** 16  # exact distances taken at once
LANE = 16


def nearest(queries: DataFrame, reference: DataFrame, k: int, ident: str, vector: str, skip_self: bool = False,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query id, neighbour, distance, rank): the exact k nearest reference rows.

    Both sides are hashed into blocks of bounded size; every pair of blocks is one group
    that returns k candidates per query, so pairs exist only as a matrix inside a task.
    A second grouping keeps the best k of the candidates.
    """
    nq = max(1, math.ceil(queries.count() / block_rows))
    nr = max(1, math.ceil(reference.count() / block_rows))
    block = lambda seed, n: (hashed(seed, F.col(ident)) % n).cast("int")
    q = queries.select(F.col(ident).alias("q"), F.col(vector).cast("array<double>").alias("v"),
                       block("q", nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r = reference.select(F.col(ident).alias("r"), F.col(vector).cast("array<double>").alias("v"),
                         block("r", nr).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    kind = dict(queries.dtypes)[ident]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "neighbour": [], "distance": []})
        ids, names = left["q"].to_numpy(), right["r"].to_numpy()
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        parts = [_closest(a[i:i + QUERY_ROWS], b, ids[i:i + QUERY_ROWS], names, k, skip_self) for i in range(0, len(a), QUERY_ROWS)]
        row, col, dist = (np.concatenate([p[i] + (n * QUERY_ROWS if i == 0 else 0) for n, p in enumerate(parts)]) for i in range(3))
        return pd.DataFrame({"q": ids[row], "neighbour": names[col], "distance": dist})

    candidates = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(
        best, f"q {kind}, neighbour {kind}, distance double")
    # k candidates per reference block: at most k * blocks rows per query
    ranked = Ordered(("q",), ("distance", "neighbour"), 1).apply(candidates, position="rank")
    return ranked.filter(F.col("rank") < k).withColumnRenamed("q", ident)


def _closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int,
             skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): the k nearest rows of b, ties to smaller names.

    One matrix product rules out most pairs, with room for its rounding; the distances of the others, and of
    rows whose product overflows, are taken from the vectors themselves.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        usable = np.isfinite(b).all(axis=1)
        middle = b[usable].mean(axis=0) if usable.any() else 0.0
        near_a, near_b = (a - middle).astype(np.float32), (b - middle).astype(np.float32)
        square_a, square_b = (near_a * near_a).sum(axis=1), (near_b * near_b).sum(axis=1)
        near = near_a @ near_b.T  # becomes the squared distance less the query's own length
        near *= -2
        near += square_b
        if skip_self:
            near[ids[:, None] == names[None, :]] = np.inf
        # k least of the least of every lane are k rows: no more than k are nearer than the last of them
        lanes = len(b) // LANE
        least = np.fmin.reduce(near[:, :lanes * LANE].reshape(len(a), LANE, lanes), axis=1) if lanes > k else near
        limit = np.partition(least, k - 1, axis=1)[:, k - 1] if k < least.shape[1] else np.full(len(a), np.inf)
        scale = (a * a).sum(axis=1) * 1e-12 + (b[usable] ** 2).sum(axis=1).max(initial=0.0) * 1e-12
        room = 5e-7 * (b.shape[1] + 8) * (square_a + square_b.max(initial=0.0, where=np.isfinite(square_b))) + scale
        limit = (limit + room).astype(np.float32)
        far = near > np.where(np.isfinite(limit), limit, np.inf)[:, None]
        row, col = np.nonzero(~far)
        if skip_self:
            other = ids[row] != names[col]
            row, col = row[other], col[other]
        dist = np.concatenate([np.zeros(0)] + [
            np.sqrt(((b[col[i:i + PAIRS]] - a[row[i:i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(row), PAIRS)])
    order = np.lexsort((names[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (rank < k) & np.isfinite(dist)
    return row[keep], col[keep], dist[keep]


def knn_score(queries: DataFrame, reference: DataFrame, k: int, ident: str, vector: str) -> DataFrame:
    """Mean distance to the k nearest reference rows."""
    return nearest(queries, reference, k, ident, vector).groupBy(ident).agg(F.avg("distance").alias("score"))


def local_outlier_factor(queries: DataFrame, reference: DataFrame, k: int, ident: str, vector: str) -> DataFrame:
    """Novelty LOF: reference density over the query's own reachability density."""
    among = nearest(reference, reference, k, ident, vector, skip_self=True)
    k_dist = among.groupBy(ident).agg(F.max("distance").alias("k_distance"))

    def density(links: DataFrame) -> DataFrame:
        reach = links.join(k_dist.withColumnRenamed(ident, "neighbour"), "neighbour").withColumn(
            "reach", F.greatest("distance", "k_distance"))
        return reach.groupBy(ident).agg((1.0 / (F.avg("reach") + 1e-10)).alias("density"))

    ref_density = density(among).withColumnRenamed(ident, "neighbour").withColumnRenamed("density", "theirs")
    links = nearest(queries, reference, k, ident, vector)
    theirs = links.join(ref_density, "neighbour").groupBy(ident).agg(F.avg("theirs").alias("theirs"))
    return theirs.join(density(links), ident).select(ident, ratio(F.col("theirs"), F.col("density")).alias("score"))


# ---------------------------------------------------------------- isolation forest
def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes, todo = [], [(np.arange(len(x)), 0, 0)]
    free = 1
    while todo:
        rows, node, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (0, 0)
        usable = np.flatnonzero(np.asarray(high) > np.asarray(low)) if len(rows) > 1 else []
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _average_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        left, right, free = free, free + 1, free + 2
        nodes.append((node, f, cut, left, right, 0.0))
        below = x[rows, f] < cut
        todo += [(rows[below], left, depth + 1), (rows[~below], right, depth + 1)]
    return nodes


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(train: DataFrame, df: DataFrame, ident: str, vector: str, trees: int = 50, sample: int = 256,
                     seed: int = 0) -> DataFrame:
    """(…, score) with score in (0, 1), larger for rows that isolate early.

    Each tree grows in its own task from about ``sample`` rows chosen by keyed hash; the
    forest (trees * 2 * sample nodes at most) travels to the scoring tasks.
    """
    n = train.count()
    copies = max(1, min(trees, math.ceil(trees * sample / max(n, 1))))
    share = min(1.0, trees * sample / (max(n, 1) * copies))
    drawn = (train.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"))
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
             .filter(uniform(seed, "keep", F.col("i"), F.col("c")) < share)
             .withColumn("tree", ((hashed(seed, F.col("i")) + F.col("c")) % trees).cast("int")))
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "c"])
        nodes = _grow(np.stack(pdf["v"].to_numpy()), np.random.default_rng(seed * 1_000_003 + int(key[0])), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "path"])
        return out.assign(tree=key[0])

    table = drawn.groupBy("tree").applyInPandas(
        grow, "node int, feature int, cut double, left int, right int, path double, tree int").toPandas()
    forest = [t.sort_values("node")[["feature", "cut", "left", "right", "path"]].to_numpy()
              for _, t in table.groupby("tree")]
    scale = _average_path(min(sample, max(2, n * copies * share / trees)))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()).astype(float)
        total = np.zeros(len(x))
        for nodes in forest:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit + 1):
                f = nodes[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] < nodes[at, 1]
                at = np.where(inner, np.where(go_left, nodes[at, 2], nodes[at, 3]).astype(int), at)
            total += nodes[at, 4]
        return pd.Series(2.0 ** (-(total / len(forest)) / scale))

    return df.withColumn("score", score(F.col(vector).cast("array<double>")))


# ---------------------------------------------------------------- evaluation helpers
PAIRS_A_TASK = 4_000


def linear_probe(df: DataFrame, ident: str, label: str, vector: str, folds: int = 5, seed: int = 0,
                 slices: int = 1) -> DataFrame:
    """Out-of-fold probabilities of a logistic model, folds stratified by keyed hash."""
    ready = as_vector(df.select(ident, F.col(label).cast("double").alias("y"), vector), vector)
    ranked = Ordered(("y",), ("_h", ident), slices).apply(ready.withColumn("_h", hashed(seed, F.col(ident))), position="_p")
    parts = ranked.withColumn("fold", F.col("_p") % folds).drop("_h", "_p", vector)
    out = None
    for i in range(folds):  # one fit per fold
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, maxIter=30).fit(
            parts.filter(F.col("fold") != i))
        got = model.transform(parts.filter(F.col("fold") == i)).select(
            ident, "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def roster_curve(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, subsets: DataFrame,
                 draws: Sequence[int]) -> DataFrame:
    """Accuracy against roster size: one fit per drawn subset of users.

    ``subsets``: (draw, label).  The loop is over the few draws.
    """
    from .metrics import classification_report
    out = None
    for draw in draws:
        users = subsets.filter(F.col("draw") == draw).select(label)
        some, held = (d.join(users, label, "left_semi") for d in (train, test))
        model = fit_identifier(some, features, label)
        if model is None:
            continue
        report = classification_report(identify(model, held, features), label, "y_pred").select(
            F.lit(draw).alias("draw"), F.lit(len(model.stages[0].labels)).alias("users"), "accuracy", "n")
        out = report if out is None else out.unionByName(report)
    return out.withColumn("chance", F.lit(1.0) / F.col("users"))


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], columns: Sequence[str],
                           positive: str, label: str, ident: str, seed: int = 0, slices: int = 1,
                           repeats: int = 1) -> DataFrame:
    """(feature, auc_drop, auc_std): loss of AUC for one class when a column is shuffled, mean over the repeats.

    A repeat pairs every row once with the row in its place of the keyed-hash order. All columns are taken
    from that partner in turn, so one join and one scoring pass serve every column and repeat. Pairs are few bytes
    but long work, so they are dealt into tasks of ``PAIRS_A_TASK`` whatever their size.
    """
    from .metrics import roc_auc
    names = list(features)
    at = [i for i, n in enumerate(model.stages[0].labels) if n == positive][0]
    base = filled(test, names).select(ident, F.col(label).alias("_label"), F.array(*names).alias("_own"))
    orders = F.array(*[F.struct(F.lit(i).alias("repeat"), hashed(seed + i, F.col(ident)).alias("_h")) for i in range(repeats)])
    ranked = Ordered((), (ident,), slices).apply(base, position="_at")
    values = Ordered(("repeat",), ("_h", ident), slices).apply(
        base.select(ident, F.col("_own").alias("_other"), F.inline(orders)), position="_at")
    tasks = max(1, math.ceil(test.count() * repeats / PAIRS_A_TASK))
    paired = ranked.join(values.select("repeat", "_at", "_other"), "_at").repartition(tasks, "repeat", "_at")
    variants = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(names.index(c)).alias("_i")) for c in columns])
    shuffled = F.transform("_own", lambda x, j: F.when(j == F.col("_i"), F.get("_other", j)).otherwise(x))
    pool = base.select(F.lit(-1).alias("repeat"), F.lit("").alias("feature"), "_label", F.col("_own").alias("_v"))
    pool = pool.unionByName(paired.select("repeat", "_label", "_own", "_other", F.inline(variants)).select(
        "repeat", "feature", "_label", shuffled.alias("_v")))
    scored = model.stages[2].transform(pool.withColumn("features", array_to_vector("_v")))
    # never null: the null filter of the AUC would score every row a second time
    score = F.coalesce(F.get(vector_to_array("probability"), F.lit(at)), F.lit(0.0))
    auc = roc_auc(scored.select("repeat", "feature", score.alias("score"), (F.col("_label") == positive).alias("positive")),
                  ["repeat", "feature"], slices)
    whole = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy())  # one row per repeat and feature
    return auc.withColumn("_base", whole).filter("feature <> ''").groupBy("feature").agg(
        F.avg(F.col("_base") - F.col("auc")).alias("auc_drop"), F.stddev_pop("auc").alias("auc_std"))


def feature_ablation(train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], label: str,
                     seeds: Sequence[int] = (7,), kind: str = "forest") -> DataFrame:
    """(group, n_features, only_accuracy, leave_out_accuracy, full_accuracy, drop_cost), means over the seeds.

    Per group one model on its features alone and one on all others; drop_cost is what leaving the group
    out costs against the model on all features. The loop is over groups and seeds.
    """
    from .metrics import classification_report
    everything = [f for g in groups.values() for f in g]
    trials = {("full", ""): everything}
    for name, own in groups.items():
        trials["only", name] = list(own)
        trials["leave_out", name] = [f for f in everything if f not in own]
    reports = None
    for (part, name), columns in trials.items():
        for seed in seeds:
            model = fit_identifier(train, columns, label, kind, seed)
            found = classification_report(identify(model, test, columns), label, "y_pred").select(
                F.lit(part).alias("part"), F.lit(name).alias("group"), "accuracy").distinct()
            reports = found if reports is None else reports.unionByName(found)
    means = reports.groupBy("part", "group").agg(F.avg("accuracy").alias("accuracy"))
    whole = means.where("part = 'full'").select(F.col("accuracy").alias("full_accuracy"))
    table = means.where("part <> 'full'").groupBy("group").pivot("part", ["only", "leave_out"]).agg(F.first("accuracy"))
    sizes = F.create_map(*[F.lit(x) for n, own in groups.items() for x in (n, len(own))])
    return table.crossJoin(F.broadcast(whole)).select(  # one row
        "group", sizes[F.col("group")].alias("n_features"), F.col("only").alias("only_accuracy"),
        F.col("leave_out").alias("leave_out_accuracy"), "full_accuracy",
        (F.col("full_accuracy") - F.col("leave_out")).alias("drop_cost"))
