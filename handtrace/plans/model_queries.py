"""Model queries: identification on the feature windows, anomaly scores on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CHEAT_FEATURES, FEATURE_GROUPS, ID_FEATURES
from ..functions.exprs import rounded, uniform
from ..operators import metrics as m, models as md, sequence as sq
from ..operators.splits import random_subsets
from ..session import cut_lineage
from ..sources.tables import table, telemetry
from .evaluation_queries import _SPLIT, DRAW, folds, table_slices
from .registry import query, r
from .sequence_queries import CHUNK, channels
from .views import with_sql
from .window_queries import feature_table, rounded_features


def embedding_rows(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("cheat", F.col("label") >= 5)
    fit = e.filter(~F.col("cheat") & (uniform("t", F.col("vec_id")) < 0.6))
    test = e.filter(F.col("cheat") | (uniform("t", F.col("vec_id")) >= 0.6))
    return fit, test


_NEAR = f"""
em AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, label < 5 AND {DRAW.format("'t|' || vec_id")} < 0.6 AS fit FROM embeddings),
dq AS (SELECT q.vec_id, f.vec_id AS nb, list_distance(q.v, f.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, f.v), f.vec_id) AS rn
       FROM em q, em f WHERE NOT q.fit AND f.fit QUALIFY rn <= 5)"""


@query("knn_anomaly", f"WITH {_NEAR} SELECT vec_id, {r('avg(d)', 'score')} FROM dq GROUP BY 1")
def knn_anomaly(spark, sf):
    fit, test = embedding_rows(spark, sf)
    return rounded(md.knn_score(test, fit, 5, "vec_id", "embedding"))


@query("local_outlier_factor", f"""WITH {_NEAR},
  df AS (SELECT q.vec_id, f.vec_id AS nb, list_distance(q.v, f.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, f.v), f.vec_id) AS rn
         FROM em q, em f WHERE q.fit AND f.fit AND q.vec_id <> f.vec_id QUALIFY rn <= 5),
  kd AS (SELECT vec_id, max(d) AS k FROM df GROUP BY 1),
  lf AS (SELECT df.vec_id, 1 / (avg(greatest(d, k)) + 1e-10) AS den FROM df JOIN kd ON kd.vec_id = nb GROUP BY 1),
  lq AS (SELECT dq.vec_id, 1 / (avg(greatest(d, k)) + 1e-10) AS den FROM dq JOIN kd ON kd.vec_id = nb GROUP BY 1),
  th AS (SELECT dq.vec_id, avg(den) AS theirs FROM dq JOIN lf ON lf.vec_id = nb GROUP BY 1)
  SELECT vec_id, {r('theirs / den', 'score')} FROM th JOIN lq USING (vec_id)""")
def local_outlier_factor(spark, sf):
    fit, test = embedding_rows(spark, sf)
    return rounded(md.local_outlier_factor(test, fit, 5, "vec_id", "embedding"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    fit, test = embedding_rows(spark, sf)
    return rounded(md.isolation_forest(fit, test, "vec_id", "embedding").select("vec_id", "label", "score"))


@query("mahalanobis")
def mahalanobis(spark, sf):
    fit, test = embedding_rows(spark, sf)
    s = md.mahalanobis(md.as_vector(fit, "embedding"), md.as_vector(test, "embedding"))
    return rounded(s.select("vec_id", "label", "score"), 4)


@query("one_class_auc")
def one_class_auc(spark, sf):
    """AUC of the one-class scorers on held-out embeddings."""
    fit, test = embedding_rows(spark, sf)
    knn = md.knn_score(test, fit, 5, "vec_id", "embedding").join(test.select("vec_id", "cheat"), "vec_id").withColumn("detector", F.lit("knn"))
    maha = md.mahalanobis(md.as_vector(fit, "embedding"), md.as_vector(test, "embedding")).withColumn("detector", F.lit("mahalanobis"))
    cols = ["detector", "score", F.col("cheat").alias("positive")]
    return rounded(m.roc_auc(knn.select(*cols).unionByName(maha.select(*cols)), ["detector"], table_slices(spark, sf, "embeddings")))


@query("linear_probe")
def linear_probe(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("cheat", (F.col("label") >= 5).cast("int"))
    n = table_slices(spark, sf, "embeddings")
    oof = md.linear_probe(e, "vec_id", "cheat", "embedding", slices=n)
    return rounded(m.roc_auc(oof.select(F.lit("probe").alias("detector"), "score", (F.col("y") == 1).alias("positive")), ["detector"], n))


def labelled_chunks(spark, sf):
    ch, tele = channels(spark, sf)
    chunks = sq.assemble_chunks(sq.apply_normaliser(ch.drop("t"), sq.fit_normaliser(ch)), CHUNK, slices=tele.slices)
    named = chunks.join(tele.sessions.select("session_id", F.when(F.col("is_cheat_session"), "cheat").otherwise("legit").alias("label")), "session_id")
    return md.as_vector(cut_lineage(named), "v")


@query("chunk_reconstruction")
def chunk_reconstruction(spark, sf):
    chunks = labelled_chunks(spark, sf)
    model, mean = md.fit_projection(chunks.filter("label = 'legit'"), 16)
    s = md.reconstruction_error(chunks, model, mean)
    return rounded(s.select("session_id", "chunk_idx", "label", "score"))


@query("chunk_embedding")
def chunk_embedding(spark, sf):
    chunks = labelled_chunks(spark, sf)
    model, mean = md.fit_projection(chunks.filter("label = 'legit'"), 16)
    e = md.embed(chunks, model, mean)
    return rounded(e.select("session_id", "chunk_idx", F.posexplode("embedding").alias("component", "value")))


@query("channel_attribution")
def channel_attribution(spark, sf):
    chunks = labelled_chunks(spark, sf)
    model, mean = md.fit_projection(chunks.filter("label = 'legit'"), 16)
    return rounded(md.channel_errors(chunks, model, mean, 8))


def identification(spark, sf):
    """Train and held-out windows, written once: trainers pass over them many times."""
    tele = telemetry(spark, sf)
    f = cut_lineage(feature_table(spark, sf).join(folds(tele).select("session_id", "fold"), "session_id"))
    return f.filter("fold = 'train'"), f.filter("fold <> 'train'")


_FILLED = ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ID_FEATURES)
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ID_FEATURES)


@query("scaled_inputs", with_sql("features", _SPLIT.strip() + f""",
zf AS (SELECT session_id, window_idx, fold, {_FILLED} FROM feat JOIN (SELECT session_id, fold FROM folds) USING (session_id)),
zs AS (SELECT {_STATS} FROM zf WHERE fold = 'train')""", "SELECT session_id, window_idx, " + ", ".join(
    r(f"({c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1.0 ELSE s_{c} END", c, 2 if c == "mouse_key_ratio" else 6)
    for c in ID_FEATURES) + " FROM zf, zs WHERE fold <> 'train'"))
def scaled_inputs(spark, sf):
    train, test = identification(spark, sf)
    return rounded_features(md.scale_like(train, test, ID_FEATURES).select("session_id", "window_idx", *ID_FEATURES))


@query("player_identification")
def player_identification(spark, sf):
    """Held-out report of the balanced forest."""
    train, test = identification(spark, sf)
    model = md.fit_identifier(train, ID_FEATURES)
    return rounded(m.classification_report(md.identify(model, test, ID_FEATURES), "player", "y_pred"))


def window_id(df):
    return df.withColumn("row", F.xxhash64("session_id", "window_idx"))


@query("batch_scoring")
def batch_scoring(spark, sf):
    """Every held-out window: probability of every player, anomaly score and flag."""
    train, test = map(window_id, identification(spark, sf))
    s = md.score_windows(md.fit_identifier(train, ID_FEATURES), train, test, ID_FEATURES, "row")
    return rounded(s.select("session_id", "window_idx", "y_pred", "anomaly_score", "is_anomaly",
                            F.explode("proba").alias("player", "probability")))


@query("model_alternatives")
def model_alternatives(spark, sf):
    train, test = identification(spark, sf)
    scaled, held = (cut_lineage(md.scale_like(train, d, ID_FEATURES)) for d in (train, test))
    out = None
    for kind in ("forest", "boosted", "logistic", "linear_svc"):
        s = md.identify(md.fit_identifier(scaled, ID_FEATURES, kind=kind), held, ID_FEATURES)
        rep = m.classification_report(s, "player", "y_pred").withColumn("model", F.lit(kind))
        out = rep if out is None else out.unionByName(rep)
    return rounded(out)


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = identification(spark, sf)
    return rounded(md.importances(md.fit_identifier(train, CHEAT_FEATURES), CHEAT_FEATURES))


@query("feature_ablation")
def feature_ablation(spark, sf):
    """Accuracy with each feature group only, without it, and what leaving it out costs."""
    train, test = identification(spark, sf)
    return rounded(md.feature_ablation(train, test, FEATURE_GROUPS, "player"))


@query("identity_under_cheating")
def identity_under_cheating(spark, sf):
    """Fit on legit sessions, score cheat sessions."""
    f = feature_table(spark, sf)
    train, test = identification(spark, sf)
    model = md.fit_identifier(train, ID_FEATURES)
    parts = {"legit": test, "cheat": f.filter("is_cheat_session")}
    out = None
    for name, part in parts.items():
        rep = m.classification_report(md.identify(model, part, ID_FEATURES), "player", "y_pred").withColumn("part", F.lit(name))
        out = rep if out is None else out.unionByName(rep)
    return rounded(out)


@query("permutation_shuffle", f"""
  WITH o AS (SELECT c_acctbal, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS own,
      row_number() OVER (ORDER BY ('0x' || substr(md5('3|' || c_custkey), 1, 15))::BIGINT, c_custkey) AS other FROM customer)
  SELECT a.c_nationkey, {r('sum(b.c_acctbal)', 'total', 2)}, count(*) AS n FROM o a JOIN o b ON a.own = b.other GROUP BY 1""")
def permutation_shuffle(spark, sf):
    """The shuffle step of permutation importance: one column in keyed-hash order."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    p = md.permute_column(c, "c_acctbal", "c_custkey", 3, table_slices(spark, sf, "customer"))
    return rounded(p.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"), F.count(F.lit(1)).alias("n")), 2)


@query("component_loadings")
def component_loadings(spark, sf):
    """Two leading components of the feature windows and the ten strongest features of each."""
    return rounded(md.loadings(cut_lineage(feature_table(spark, sf)), CHEAT_FEATURES, 2).filter("rank < 10"))


@query("roster_curve")
def roster_curve(spark, sf):
    """Accuracy over rosters of three players, three draws."""
    train, test = identification(spark, sf)
    subsets = random_subsets(train.select("player"), "player", 3, 3)
    return rounded(md.roster_curve(train, test, ID_FEATURES, "player", subsets, [0, 1, 2]))


@query("permutation_importance")
def permutation_importance(spark, sf):
    """AUC lost for player p0 when a column is shuffled, every column, eight repeats."""
    train, test = map(window_id, identification(spark, sf))
    model = md.fit_identifier(train, ID_FEATURES)
    return rounded(md.permutation_importance(
        model, test, ID_FEATURES, ID_FEATURES, "p0", "player", "row", slices=table_slices(spark, sf, "events"), repeats=8))
