"""Drift, rank tests, ranking metrics, calibration, verification and risk queries.

Scores come from ``labels`` joined with ``documents``; drift compares ``lineitem`` before
and after a ship date; predictions are drawn over ``customer`` segments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.exprs import cosine, rounded, uniform
from ..functions.ordered import slices_for
from ..operators import metrics as m, risk as rk, splits as sp, stats as st
from ..sources.tables import DAY_MS, telemetry, table
from .registry import query, r
from .views import events_sql, sessions_sql, with_sql
from .window_queries import feature_table

DRAW = "(('0x' || substr(md5({}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"
CUT = "1999-01-01"
LINE_COLS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def table_slices(spark, sf, name):
    return slices_for(table(spark, sf, name).count())


# ---------------------------------------------------------------- lineitem drift
def line_values(spark, sf, *ids):
    li = table(spark, sf, "lineitem").select(
        *[F.col(c).alias(n) for n, c in LINE_COLS.items()], "l_returnflag",
        (F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz")).alias("late"))
    return st.upright(li, list(LINE_COLS), ["l_returnflag", "late"]), table_slices(spark, sf, "lineitem")


_LONG = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {c} AS value, l_returnflag, l_shipdate >= TIMESTAMP '{CUT}' AS late FROM lineitem"
    for n, c in LINE_COLS.items()) + ")"

_KS = """
kc AS (SELECT feature, value, sum((NOT late)::INT) AS rf, sum(late::INT) AS cr FROM lv GROUP BY 1, 2),
kr AS (SELECT feature, sum(rf) OVER w AS a, sum(cr) OVER w AS b FROM kc WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
kt AS (SELECT feature, sum(rf)::BIGINT AS n_ref, sum(cr)::BIGINT AS n_cur FROM kc GROUP BY 1),
ks AS (SELECT feature, n_ref, n_cur, max(abs(a / n_ref::DOUBLE - b / n_cur::DOUBLE)) AS ks_stat FROM kr JOIN kt USING (feature) GROUP BY 1, 2, 3),
kp AS (SELECT *, sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) * ks_stat AS lam FROM ks),
kq AS (SELECT *, CASE WHEN lam < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * list_sum(list_transform(range(1, 101),
        lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))))) END AS ks_pvalue FROM kp)"""
_PSI = """
pq AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM lv WHERE NOT late GROUP BY 1),
pi AS (SELECT feature, edges, edges[2:-2] AS inn FROM pq),
pb AS (SELECT lv.feature, len(list_filter(inn, lambda e: e <= value)) AS bin, sum((NOT late)::INT) AS a, sum(late::INT) AS b FROM lv JOIN pi USING (feature) GROUP BY 1, 2),
pg AS (SELECT feature, unnest(range(len(inn) + 1)) AS bin FROM pi),
ps AS (SELECT g.feature, greatest(coalesce(a, 0) / n_ref::DOUBLE, 1e-6) AS pr, greatest(coalesce(b, 0) / n_cur::DOUBLE, 1e-6) AS pc
       FROM pg g LEFT JOIN pb USING (feature, bin) JOIN kt ON kt.feature = g.feature),
psi AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM ps GROUP BY 1)"""


@query("ks_statistic", f"WITH {_LONG}, {_KS} SELECT feature, n_ref, n_cur, {r('ks_stat', 'ks_stat')} FROM ks")
def ks_statistic(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.ks_statistic(long, F.col("late"), slices=n))


@query("psi", f"WITH {_LONG}, {_KS}, {_PSI} SELECT feature, {r('psi', 'psi')} FROM psi")
def psi(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.psi(long, F.col("late"), slices=n))


@query("drift_report", f"""WITH {_LONG}, {_KS}, {_PSI}
  SELECT feature, n_ref, n_cur, {r('ks_stat', 'ks_stat')}, {r('ks_pvalue', 'ks_pvalue')}, ks_pvalue < 0.05 AS ks_drifted, {r('psi', 'psi')},
    CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS psi_severity
  FROM kq JOIN psi USING (feature)""")
def drift_report(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.drift_report(long, F.col("late"), slices=n))


@query("psi_severity", f"""WITH {_LONG}, {_KS}, {_PSI}
  SELECT feature, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS severity FROM psi""")
def psi_severity(spark, sf):
    long, n = line_values(spark, sf)
    return st.psi(long, F.col("late"), slices=n).select("feature", st.severity(F.col("psi")).alias("severity"))



def _gap_sql() -> str:
    from .sequence_queries import _CHANNELS
    from ..operators.sequence import CHANNEL_NAMES
    upright = " UNION ALL ".join(f"SELECT player, '{c}' AS feature, {c} AS value FROM ch JOIN sess USING (session_id)" for c in CHANNEL_NAMES)
    return with_sql("sessions", f"""{_CHANNELS.strip()},
up AS ({upright}),
lv AS (SELECT player || '|' || feature AS feature, value, TRUE AS late FROM up WHERE player <> 'p0'
  UNION ALL SELECT t.player || '|' || u.feature, u.value, FALSE FROM up u, (SELECT DISTINCT player FROM up WHERE player <> 'p0') t
  WHERE u.player = 'p0'),{_KS},{_PSI}""", f"""
SELECT split_part(kq.feature, '|', 1) AS target, split_part(kq.feature, '|', 2) AS feature, n_ref, n_cur, {r('ks_stat', 'ks_stat')},
  {r('ks_pvalue', 'ks_pvalue')}, ks_pvalue < 0.05 AS ks_drifted, {r('psi', 'psi')},
  CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS psi_severity
FROM kq LEFT JOIN (SELECT psi.* FROM psi JOIN pq USING (feature) WHERE len(edges) >= 2) p ON p.feature = kq.feature""")


@query("domain_gap", _gap_sql())
def domain_gap(spark, sf):
    """Channel drift of every player's input against player p0, keyed by target."""
    from .sequence_queries import channels
    from ..operators.sequence import CHANNEL_NAMES
    ch, tele = channels(spark, sf)
    owner = tele.sessions.select("session_id", "player")
    long = st.upright(ch.join(owner, "session_id"), CHANNEL_NAMES, ["player"])
    return rounded(st.drift_against(long, "player", "p0", slices=table_slices(spark, sf, "events")))


_RANKS = """
vc AS (SELECT feature, value, sum((l_returnflag = 'A')::INT) AS a, sum((l_returnflag = 'N')::INT) AS b, sum((l_returnflag = 'R')::INT) AS c FROM lv GROUP BY 1, 2)"""
_MWU = """
mr AS (SELECT feature, a, c, a + c AS m, sum(a + c) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - (a + c - 1) / 2.0::DOUBLE AS rk FROM vc),
ms AS (SELECT feature, sum(a)::BIGINT AS n_a, sum(c)::BIGINT AS n_b, sum(a * rk) AS ra, sum(m::DOUBLE * m * m - m) AS ties FROM mr GROUP BY 1),
mu AS (SELECT *, ra - n_a::DOUBLE * (n_a + 1) / 2 AS u, (n_a + n_b)::DOUBLE AS n FROM ms),
mz AS (SELECT *, greatest(abs(u - n_a::DOUBLE * n_b / 2) - 0.5, 0) / sqrt(n_a::DOUBLE * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))) / sqrt(2.0::DOUBLE) AS x FROM mu)"""


def _erfc(x: str) -> str:
    """The complementary error function in SQL: partial sums below 2, convergents from there on."""
    series, fraction = "1.0::DOUBLE", x
    for k in range(40, 0, -1):
        series = f"(1 + 2 * {x} * {x} / {2 * k + 1}::DOUBLE * {series})"
    for k in range(60, 0, -1):
        fraction = f"({x} + {k / 2}::DOUBLE / {fraction})"
    scale = f"(exp(-{x} * {x}) / sqrt(pi()))"
    return f"CASE WHEN {x} < 2 THEN 1 - 2 * {x} * {scale} * {series} ELSE {scale} / {fraction} END"



@query("mann_whitney", f"""WITH {_LONG}, {_RANKS}, {_MWU}
  SELECT feature, n_a, n_b, {r('u', 'u', 1)}, {r('2 * u / (n_a::DOUBLE * n_b) - 1', 'effect')},
    {r(_erfc('x'), 'p_value')} FROM mz""")
def mann_whitney(spark, sf):
    long, n = line_values(spark, sf)
    two = long.filter(F.col("l_returnflag").isin("A", "R"))
    t = st.mann_whitney(two, F.col("l_returnflag") == "R", slices=n)
    return rounded(t.withColumn("u", F.round("u", 1)))


_KRUSKAL = f"""WITH {_LONG}, {_RANKS},
  kr AS (SELECT feature, a, b, c, a + b + c AS m, sum(a + b + c) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - (a + b + c - 1) / 2.0::DOUBLE AS rk FROM vc),
  kz AS (SELECT feature, sum(m)::DOUBLE AS n, sum(m::DOUBLE * m * m - m) AS ties, pow(sum(a * rk), 2) / sum(a) + pow(sum(b * rk), 2) / sum(b) + pow(sum(c * rk), 2) / sum(c) AS parts FROM kr GROUP BY 1),
  kh AS (SELECT feature, n::BIGINT AS n, (12 / (n * (n + 1)) * parts - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM kz)"""


@query("kruskal_wallis", f"{_KRUSKAL} SELECT feature, n, {r('h', 'h', 5)}, 2 AS df FROM kh")
def kruskal_wallis(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.kruskal(long, "l_returnflag", ["A", "N", "R"], slices=n), 5)


@query("kruskal_wallis_p", f"""{_KRUSKAL}
  SELECT feature, n, {r('h', 'h', 5)}, 2 AS df, {r('exp(-greatest(h, 0) / 2)', 'p_value', 5)} FROM kh""")
def kruskal_wallis_p(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.with_chi2_p(st.kruskal(long, "l_returnflag", ["A", "N", "R"], slices=n)), 5)


@query("robust_effect", f"""WITH {_LONG},
  q AS (SELECT feature, l_returnflag, quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS c FROM lv GROUP BY 1, 2)
  SELECT q.feature, q.l_returnflag, {r('(q.b - z.b) / coalesce(nullif(z.c - z.a, 0), 1e-6)', 'effect')}
  FROM q JOIN q z ON z.feature = q.feature AND z.l_returnflag = 'N' WHERE q.l_returnflag <> 'N'""")
def robust_effect(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.robust_effect(long, "l_returnflag", "N", n))


@query("describe", f"""WITH {_LONG}
  SELECT feature, count(*) AS count, {r('avg(value)', 'mean', 4)}, {r('stddev_samp(value)', 'std', 4)}, {r('min(value)', 'min', 4)}, {r('max(value)', 'max', 4)},
    {r('quantile_cont(value, 0.25)', 'p25', 4)}, {r('median(value)', 'p50', 4)}, {r('quantile_cont(value, 0.75)', 'p75', 4)} FROM lv GROUP BY 1""")
def describe(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.describe(long, slices=n), 4)


_PAIRS = [(a, b) for i, a in enumerate(LINE_COLS) for b in list(LINE_COLS)[i:]]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({LINE_COLS[a]}, {LINE_COLS[b]})', 'corr')} FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, sf):
    li = table(spark, sf, "lineitem").select(*[F.col(c).alias(n) for n, c in LINE_COLS.items()])
    return rounded(st.correlations(li, list(LINE_COLS)))


@query("top_keys", events_sql("SELECT key, count(*) AS n FROM ev WHERE key IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 20"))
def top_keys(spark, sf):
    return st.top_values(telemetry(spark, sf).events, "key", 20)


@query("quantile_trim", f"""SELECT l_returnflag, count(*) AS n, {r('sum(l_extendedprice)', 'total', 2)} FROM lineitem,
  (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
  WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def quantile_trim(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    t = st.quantile_trim(li, "l_extendedprice", slices=table_slices(spark, sf, "lineitem"))
    return rounded(t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@query("ecdf", f"""WITH {_LONG}, c AS (SELECT feature, value, count(*) AS n FROM lv GROUP BY 1, 2)
  SELECT feature, {r('value', 'value')}, {r('sum(n) OVER w / sum(n) OVER (PARTITION BY feature)::DOUBLE', 'ecdf')} FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)""")
def ecdf(spark, sf):
    long, n = line_values(spark, sf)
    return rounded(st.ecdf(long, slices=n))


@query("common_histogram", f"""WITH {_LONG},
  x AS (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM lv)
  SELECT feature, late, least(19, coalesce(floor((value - lo) * 20 / nullif(hi - lo, 0)), 0))::INT AS bin, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def common_histogram(spark, sf):
    return st.common_histogram(line_values(spark, sf)[0], "late")


@query("event_timeline", events_sql(f"""
  SELECT session_id, floor(t / {DAY_MS})::BIGINT AS second, """ + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("mouse_move", "mouse_click", "mouse_scroll", "key_press", "key_release"))
    + " FROM ev GROUP BY 1, 2"))
def event_timeline(spark, sf):
    from ..constants import EVENT_KINDS
    return st.event_timeline(telemetry(spark, sf).events, EVENT_KINDS, DAY_MS)


# ---------------------------------------------------------------- scores
def scores(spark, sf):
    """(doc_id, group_id, detector, label, difficulty, score) from labels and documents."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    d = F.col("doc_id")
    label = F.when(F.col("toxic") == 1, F.when(d % 2 == 0, "aimbot").otherwise("macro")).otherwise("legit")
    h = uniform("h", d)
    det = F.array(
        F.struct(F.lit("length").alias("detector"), (F.col("n_chars") / 1000.0).alias("score")),
        F.struct(F.lit("hash").alias("detector"), (F.lit(0.25) * F.col("toxic") + F.lit(0.75) * h).alias("score")),
        F.struct(F.lit("coarse").alias("detector"),
                 (F.floor((F.lit(0.4) * F.col("toxic") + F.lit(0.6) * uniform("c", d)) * 10) / 10.0).alias("score")))
    diff = F.when(d % 3 == 0, "soft").when(d % 3 == 1, "obvious")
    return j.select("doc_id", (d % 20).alias("group_id"), label.alias("label"), diff.alias("difficulty"),
                    "toxic", "quality", F.inline(det))


_SCORES = f"""
base AS (SELECT l.doc_id, l.doc_id % 20 AS group_id, toxic, quality,
    CASE WHEN toxic = 1 THEN CASE WHEN l.doc_id % 2 = 0 THEN 'aimbot' ELSE 'macro' END ELSE 'legit' END AS label,
    CASE l.doc_id % 3 WHEN 0 THEN 'soft' WHEN 1 THEN 'obvious' END AS difficulty, n_chars
  FROM labels l JOIN documents d USING (doc_id)),
sc AS (SELECT *, 'length' AS detector, n_chars / 1000.0::DOUBLE AS score FROM base
  UNION ALL SELECT *, 'hash', 0.25::DOUBLE * toxic + 0.75::DOUBLE * {DRAW.format("'h|' || doc_id")} FROM base
  UNION ALL SELECT *, 'coarse', floor((0.4::DOUBLE * toxic + 0.6::DOUBLE * {DRAW.format("'c|' || doc_id")}) * 10) / 10.0::DOUBLE FROM base)"""


def sc_sql(body: str, extra: str = "") -> str:
    return f"WITH {_SCORES}{', ' + extra if extra else ''} {body}"


_AUC = """
auc_c AS ({src}),
auc_v AS (SELECT {keys}, score, sum(p) AS pp, sum(1 - p) AS nn FROM auc_c GROUP BY {keys}, score),
auc_r AS (SELECT {keys}, pp, nn, sum(pp + nn) OVER (PARTITION BY {keys} ORDER BY score ROWS UNBOUNDED PRECEDING) - (pp + nn - 1) / 2.0::DOUBLE AS rk FROM auc_v),
auc_t AS (SELECT {keys}, sum(pp)::BIGINT AS n_pos, sum(nn)::BIGINT AS n_neg, sum(pp * rk) AS rs FROM auc_r GROUP BY {keys}),
auc AS (SELECT {keys}, n_pos, n_neg, (rs - n_pos::DOUBLE * (n_pos + 1) / 2) / nullif(n_pos::DOUBLE * n_neg, 0) AS auc FROM auc_t),
crv AS (SELECT {keys}, score, pp, nn, sum(pp) OVER w AS tp, sum(nn) OVER w AS fp, sum(pp) OVER (PARTITION BY {keys}) AS pos, sum(nn) OVER (PARTITION BY {keys}) AS neg
        FROM auc_v WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {keys}, sum(pp / pos::DOUBLE * tp / (tp + fp)) AS ap FROM crv GROUP BY {keys}),
fpr AS (SELECT {keys}, coalesce(max(tp / pos::DOUBLE) FILTER (fp <= 0.05 * neg), 0) AS detection_rate FROM crv GROUP BY {keys})"""
_BY_DET = _AUC.format(src="SELECT detector, score, toxic AS p FROM sc", keys="detector")


def by_detector(spark, sf):
    return scores(spark, sf).withColumn("positive", F.col("toxic") == 1), table_slices(spark, sf, "labels")


@query("roc_auc", sc_sql(f"SELECT detector, n_pos, n_neg, {r('auc', 'auc')} FROM auc", _BY_DET))
def roc_auc(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.roc_auc(s, ["detector"], n))


@query("average_precision", sc_sql(f"SELECT detector, {r('ap', 'ap')} FROM ap", _BY_DET))
def average_precision(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.average_precision(m.threshold_counts(s, ["detector"], n), ["detector"]))


@query("rate_at_fpr", sc_sql(f"SELECT detector, {r('detection_rate', 'detection_rate')} FROM fpr", _BY_DET))
def rate_at_fpr(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.rate_at_fpr(m.threshold_counts(s, ["detector"], n), ["detector"]))


@query("roc_curve", sc_sql(f"SELECT detector, {r('score', 'score')}, {r('fp / neg::DOUBLE', 'fpr')}, {r('tp / pos::DOUBLE', 'tpr')} FROM crv", _BY_DET))
def roc_curve(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.roc_points(m.threshold_counts(s, ["detector"], n), ["detector"]))


@query("pr_curve", sc_sql(f"SELECT detector, {r('score', 'score')}, {r('tp / (tp + fp)::DOUBLE', 'precision')}, {r('tp / pos::DOUBLE', 'recall')} FROM crv", _BY_DET))
def pr_curve(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.pr_points(m.threshold_counts(s, ["detector"], n), ["detector"]))


_DET = """
det0 AS (SELECT *, max(score) FILTER (tp = pos) OVER (PARTITION BY detector) AS lo,
           min(fp) OVER (PARTITION BY detector) AS f0 FROM crv),
det1 AS (SELECT *, min(score) FILTER (fp = f0) OVER (PARTITION BY detector) AS hi FROM det0),
det AS (SELECT detector, score AS threshold, fp / neg::DOUBLE AS far, (pos - tp) / pos::DOUBLE AS frr FROM det1 WHERE score >= lo AND score <= hi),
nx AS (SELECT *, far - frr AS d, lead(far - frr) OVER w AS d1, lead(far) OVER w AS far1, lead(threshold) OVER w AS t1 FROM det WINDOW w AS (PARTITION BY detector ORDER BY threshold)),
cross_ AS (SELECT detector, threshold, d1 IS NOT NULL AND sign(d1) <> sign(d) AS chg, far, frr, d,
   CASE WHEN d1 = d THEN 0 ELSE -d / (d1 - d) END AS w, far1, t1 FROM nx),
eer AS (SELECT detector, coalesce(arg_min(far + w * (far1 - far), threshold) FILTER (chg), arg_min((far + frr) / 2, (abs(d), threshold))) AS eer,
   coalesce(arg_min(threshold + w * (t1 - threshold), threshold) FILTER (chg), arg_min(threshold, (abs(d), threshold))) AS threshold FROM cross_ GROUP BY 1)"""


def det(spark, sf):
    s, n = by_detector(spark, sf)
    return m.det_points(m.threshold_counts(s, ["detector"], n), ["detector"]), n


@query("det_curve", sc_sql(f"SELECT detector, {r('threshold', 'threshold')}, {r('far', 'far')}, {r('frr', 'frr')} FROM det", _BY_DET + "," + _DET))
def det_curve(spark, sf):
    return rounded(det(spark, sf)[0])


@query("equal_error_rate", sc_sql(f"SELECT detector, {r('eer', 'eer')}, {r('threshold', 'threshold')} FROM eer", _BY_DET + "," + _DET))
def equal_error_rate(spark, sf):
    d, n = det(spark, sf)
    return rounded(m.equal_error_rate(d, ["detector"], n))


@query("far_at_frr", sc_sql(f"SELECT detector, {r('coalesce(min(far) FILTER (frr <= 0.05), 1)', 'far_at_frr')} FROM det GROUP BY 1", _BY_DET + "," + _DET))
def far_at_frr(spark, sf):
    return rounded(m.far_at_frr(det(spark, sf)[0], ["detector"]))


_GRID = """
gr AS (SELECT detector, label, score, 1 AS p FROM sc WHERE label <> 'legit'
  UNION ALL SELECT s.detector, n.label, score, 0 FROM sc s JOIN (SELECT DISTINCT detector, label FROM sc WHERE label <> 'legit') n USING (detector) WHERE s.label = 'legit'),
mn AS (SELECT detector, label, avg(score) FILTER (p = 1) AS mean_cheat, avg(score) FILTER (p = 0) AS mean_legit FROM gr GROUP BY 1, 2)"""
_BY_GRID = _GRID + "," + _AUC.format(src="SELECT detector, label, score, p FROM gr", keys="detector, label")


@query("benchmark_grid", sc_sql(f"""
  SELECT detector, label, n_pos, n_neg, {r('auc', 'auc')}, {r('ap', 'ap')}, {r('detection_rate', 'detection_rate')}, {r('mean_cheat', 'mean_cheat')}, {r('mean_legit', 'mean_legit')}
  FROM auc JOIN ap USING (detector, label) JOIN fpr USING (detector, label) JOIN mn USING (detector, label)""", _BY_GRID))
def benchmark_grid(spark, sf):
    return rounded(m.benchmark_grid(scores(spark, sf), slices=table_slices(spark, sf, "labels")))


@query("benchmark_by_difficulty", sc_sql(f"""
  SELECT detector, label, n_pos, n_neg, {r('auc', 'auc')}, {r('ap', 'ap')}, {r('detection_rate', 'detection_rate')}, {r('mean_cheat', 'mean_cheat')}, {r('mean_legit', 'mean_legit')}
  FROM auc JOIN ap USING (detector, label) JOIN fpr USING (detector, label) JOIN mn USING (detector, label)""", """
pl AS (SELECT detector, label || ':' || difficulty AS label, score FROM sc WHERE label <> 'legit' AND difficulty IS NOT NULL
  UNION ALL SELECT detector, label || ':all', score FROM sc WHERE label <> 'legit'),
gr AS (SELECT *, 1 AS p FROM pl UNION ALL SELECT s.detector, n.label, s.score, 0 FROM sc s JOIN (SELECT DISTINCT detector, label FROM pl) n USING (detector) WHERE s.label = 'legit'),
mn AS (SELECT detector, label, avg(score) FILTER (p = 1) AS mean_cheat, avg(score) FILTER (p = 0) AS mean_legit FROM gr GROUP BY 1, 2),"""
  + _AUC.format(src="SELECT detector, label, score, p FROM gr", keys="detector, label")))
def benchmark_by_difficulty(spark, sf):
    """The grid per difficulty: soft, obvious and everything."""
    from ..operators.labels import pooled_by_difficulty
    s = scores(spark, sf)
    cheats = pooled_by_difficulty(s.filter("label <> 'legit'")).withColumn("label", F.concat_ws(":", "label", "pool"))
    legit = s.filter("label = 'legit'")
    pool = cheats.select("detector", "label", "score").unionByName(legit.select("detector", "label", "score"))
    return rounded(m.benchmark_grid(pool, slices=table_slices(spark, sf, "labels")))


@query("benchmark_pivot", sc_sql(f"""
  SELECT detector, {r("max(auc) FILTER (label = 'aimbot')", 'aimbot')}, {r("max(auc) FILTER (label = 'macro')", 'macro')} FROM auc GROUP BY 1""", _BY_GRID))
def benchmark_pivot(spark, sf):
    g = m.benchmark_grid(scores(spark, sf), slices=table_slices(spark, sf, "labels"))
    return rounded(m.benchmark_pivot(g, ["aimbot", "macro"]))


_HOLD = """
rp AS (SELECT r.repeat::INT AS repeat, g.group_id, row_number() OVER (PARTITION BY r.repeat ORDER BY ('0x' || substr(md5('0:' || r.repeat || '|' || g.group_id), 1, 15))::BIGINT, g.group_id) - 1 AS rnk,
         count(*) OVER (PARTITION BY r.repeat) AS n
       FROM (SELECT DISTINCT group_id FROM sc) g, (SELECT unnest(range(20)) AS repeat) r),
hs AS (SELECT repeat, group_id, rnk < greatest(1, round_even(n * 0.4, 0)) AS held_out FROM rp)"""


@query("repeated_holdout", sc_sql("SELECT repeat, group_id, held_out FROM hs", _HOLD))
def repeated_holdout(spark, sf):
    g = scores(spark, sf).select("group_id")
    return sp.repeated_holdout(g, 20)


@query("heldout_benchmark", sc_sql(f"""
  SELECT detector, {r('avg(auc)', 'auc_mean')}, count(auc) AS repeats, {r('quantile_cont(auc, 0.025)', 'auc_low')}, {r('quantile_cont(auc, 0.975)', 'auc_high')}, {r('median(n_pos + n_neg)', 'median_test')}
  FROM auc GROUP BY 1""", _HOLD + "," + _AUC.format(
      src="SELECT detector, repeat, score, toxic AS p FROM sc JOIN hs USING (group_id) WHERE held_out", keys="detector, repeat")))
def heldout_benchmark(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.heldout_benchmark(s, sp.repeated_holdout(s.select("group_id"), 20), n))


_BOOT = """
nb AS (SELECT detector, row_number() OVER (PARTITION BY detector ORDER BY doc_id) - 1 AS rnk, toxic, (score >= 0.5)::INT AS said, score,
         count(*) OVER (PARTITION BY detector) AS n FROM sc),
pk AS (SELECT detector, d.draw, ('0x' || substr(md5(d.draw || '|' || p.rnk), 1, 15))::BIGINT % p.n AS rnk
       FROM nb p, (SELECT unnest(range({draws})) AS draw) d),
dr AS (SELECT detector, draw, toxic, said, score FROM pk JOIN nb USING (detector, rnk))"""
DRAWS, AUC_DRAWS = 2000, 1000


@query("bootstrap_accuracy", sc_sql(f"""
  SELECT detector, metric, count(*) AS draws, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.025)', 'low')}, {r('quantile_cont(v, 0.975)', 'high')} FROM (
    SELECT detector, draw, 'accuracy' AS metric, sum(n) FILTER (toxic = said) / sum(n)::DOUBLE AS v FROM cl GROUP BY 1, 2
    UNION ALL SELECT detector, draw, 'macro_f1', avg(2 * hit / sides::DOUBLE) FROM (
      SELECT detector, draw, cls, sum(hit) AS hit, sum(n) AS sides FROM (
        SELECT detector, draw, toxic AS cls, n, CASE WHEN toxic = said THEN n ELSE 0 END AS hit FROM cl
        UNION ALL SELECT detector, draw, said, n, 0 FROM cl) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1, 2""",
  _BOOT.format(draws=DRAWS) + ", cl AS (SELECT detector, draw, toxic, said, count(*) AS n FROM dr GROUP BY ALL)"))
def bootstrap_accuracy(spark, sf):
    """Intervals of accuracy and macro F1 of every detector's verdicts."""
    s, n = by_detector(spark, sf)
    said = s.withColumn("said", (F.col("score") >= 0.5).cast("int"))
    return rounded(m.bootstrap(said, DRAWS, "toxic", "said", "doc_id", ["detector"], n))


@query("bootstrap_auc", sc_sql(f"""
  SELECT detector, count(*) AS draws, {r('avg(auc)', 'mean')}, {r('quantile_cont(auc, 0.025)', 'low')}, {r('quantile_cont(auc, 0.975)', 'high')}
  FROM auc WHERE auc IS NOT NULL GROUP BY 1""",
  _BOOT.format(draws=AUC_DRAWS) + "," + _AUC.format(src="SELECT detector, draw, score, toxic AS p FROM dr", keys="detector, draw")))
def bootstrap_auc(spark, sf):
    s, n = by_detector(spark, sf)
    return rounded(m.bootstrap_auc(s, AUC_DRAWS, "doc_id", ["detector"], n))


@query("anomaly_summary", sc_sql(f"""
  SELECT detector, {r('avg(score)', 'mean')}, {r('stddev_pop(score)', 'std')}, {r('min(score)', 'min')}, {r('max(score)', 'max')}, {r('avg((score > 0.8)::INT)', 'outlier_share')} FROM sc GROUP BY 1"""))
def anomaly_summary(spark, sf):
    return rounded(m.anomaly_summary(scores(spark, sf), "score", F.col("score") > 0.8, ["detector"]))


# ---------------------------------------------------------------- multiclass predictions
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def predictions(spark, sf):
    """Class probabilities per customer, mostly right, from keyed draws."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("y_true"))
    w = lambda s: uniform(s, F.col("c_custkey")) + F.when(F.col("y_true") == s, 0.5).otherwise(0.0)
    weighed = c.withColumns({f"_{s}": w(s) for s in SEGMENTS})
    total = sum(F.col(f"_{s}") for s in SEGMENTS)
    probs = F.array(*[F.struct(F.lit(s).alias("key"), (F.col(f"_{s}") / total).alias("value")) for s in SEGMENTS])
    best = F.array_max(F.transform(F.col("_p"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return weighed.withColumn("_p", probs).select(
        "c_custkey", "c_nationkey", "y_true", F.map_from_entries("_p").alias("proba"),
        best["k"].alias("y_pred"), best["v"].alias("confidence"))


_PRED = f"""
cl AS (SELECT unnest({SEGMENTS!r}) AS cls),
wt AS (SELECT c_custkey, c_nationkey, c_mktsegment AS y_true, cls, {DRAW.format("cls || '|' || c_custkey")} + CASE WHEN c_mktsegment = cls THEN 0.5 ELSE 0 END AS w FROM customer, cl),
pb AS (SELECT *, w / sum(w) OVER (PARTITION BY c_custkey) AS p FROM wt),
pr AS (SELECT c_custkey, c_nationkey, y_true, arg_max(cls, (p, cls)) AS y_pred, max(p) AS confidence FROM pb GROUP BY 1, 2, 3)"""


def pred_sql(body: str, extra: str = "") -> str:
    return f"WITH {_PRED}{', ' + extra if extra else ''} {body}"


_REL = """
rel AS (SELECT b.bin::INT AS bin, b.bin / 10.0::DOUBLE AS low, coalesce(n, 0)::BIGINT AS n, confidence, accuracy FROM (SELECT unnest(range(10)) AS bin) b
  LEFT JOIN (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS confidence, avg((y_true = y_pred)::INT) AS accuracy FROM pr GROUP BY 1) USING (bin))"""


@query("reliability_curve", pred_sql(f"SELECT bin, {r('low', 'low')}, n, {r('confidence', 'confidence')}, {r('accuracy', 'accuracy')} FROM rel", _REL))
def reliability_curve(spark, sf):
    p = predictions(spark, sf)
    return rounded(m.reliability_curve(p, "confidence", F.col("y_true") == F.col("y_pred")))


@query("calibration_error", pred_sql(f"SELECT {r('sum(n * abs(accuracy - confidence)) / sum(n)', 'ece')} FROM rel", _REL))
def calibration_error(spark, sf):
    p = predictions(spark, sf)
    return rounded(m.expected_calibration_error(m.reliability_curve(p, "confidence", F.col("y_true") == F.col("y_pred"))))


@query("brier_score", pred_sql(f"SELECT {r('avg(b)', 'brier')} FROM (SELECT c_custkey, sum(pow(p - (cls = y_true)::INT, 2)) AS b FROM pb GROUP BY 1)"))
def brier_score(spark, sf):
    return rounded(m.brier(predictions(spark, sf), "y_true"))


@query("classification_report", pred_sql(f"""
  SELECT {r('sum(tp) / sum(support)::DOUBLE', 'accuracy')}, {r('sum(p * support) / sum(support)', 'precision_weighted')}, {r('sum(rc * support) / sum(support)', 'recall_weighted')},
    {r('sum(coalesce(2 * p * rc / nullif(p + rc, 0), 0) * support) / sum(support)', 'f1_weighted')}, sum(support)::BIGINT AS n FROM (
    SELECT cls, count(*) FILTER (y_true = cls) AS support, count(*) FILTER (y_true = cls AND y_pred = cls) AS tp,
      coalesce(count(*) FILTER (y_true = cls AND y_pred = cls) / nullif(count(*) FILTER (y_pred = cls), 0)::DOUBLE, 0) AS p,
      count(*) FILTER (y_true = cls AND y_pred = cls) / count(*) FILTER (y_true = cls)::DOUBLE AS rc FROM pr, cl GROUP BY 1)"""))
def classification_report(spark, sf):
    return rounded(m.classification_report(predictions(spark, sf), "y_true", "y_pred"))


@query("confusion_matrix", pred_sql("SELECT y_true, " + ", ".join(f"count(*) FILTER (y_pred = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM pr GROUP BY 1"))
def confusion_matrix(spark, sf):
    return m.confusion_matrix(predictions(spark, sf), "y_true", "y_pred", SEGMENTS)


@query("majority_baseline", f"SELECT {r('max(n) / sum(n)::DOUBLE', 'majority_accuracy')} FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def majority_baseline(spark, sf):
    return rounded(m.majority_baseline(table(spark, sf, "customer"), "c_mktsegment"))


@query("class_weights", f"SELECT c_mktsegment, n, {r('sum(n) OVER () / (count(*) OVER () * n::DOUBLE)', 'weight')} FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def class_weights(spark, sf):
    return rounded(st.class_weights(table(spark, sf, "customer"), "c_mktsegment"))


@query("verification_trials", pred_sql(f"""
  SELECT cls AS claimed, y_true = cls AS positive, count(*) AS n, {r('avg(p)', 'score')} FROM pb GROUP BY 1, 2"""))
def verification_trials(spark, sf):
    t = m.verification_trials(predictions(spark, sf), "y_true")
    return rounded(t.groupBy("claimed", "positive").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")))


_SESS_EER = """
tr AS (SELECT 'session' AS detector, 'c' || c_nationkey || y_true AS session_id, cls, avg(p) AS score, max((cls = y_true)::INT) AS p FROM pb GROUP BY c_nationkey, y_true, cls)"""


@query("session_verification", pred_sql(f"SELECT {r('eer', 'eer')}, {r('threshold', 'threshold')} FROM eer",
                                         _SESS_EER + "," + _AUC.format(src="SELECT detector, score, p FROM tr", keys="detector") + "," + _DET))
def session_verification(spark, sf):
    """Customers of one nation and segment stand for the windows of a session."""
    p = predictions(spark, sf).withColumn("session_id", F.concat(F.lit("c"), F.col("c_nationkey"), F.col("y_true")))
    trials = m.session_trials(p, "y_true", SEGMENTS)
    n = table_slices(spark, sf, "customer")
    return rounded(m.equal_error_rate(m.det_points(m.threshold_counts(trials, [], n), []), [], n))


_EMB = f"""
em AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {DRAW.format("'e|' || vec_id")} < 0.5 AS enrol FROM embeddings),
fl AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM em WHERE enrol) GROUP BY 1, 2),
ct AS (SELECT label AS claimed, list(x ORDER BY i) AS c FROM fl GROUP BY 1),
et AS (SELECT 'cosine' AS detector, vec_id, claimed, list_cosine_similarity(v, c) AS score, (claimed = label)::INT AS p FROM (
    SELECT *, CASE WHEN vec_id % 2 = 0 THEN label ELSE (label + 1 + (vec_id // 2) % 9) % 10 END AS claimed FROM em WHERE NOT enrol) JOIN ct USING (claimed))"""


def embedding_trials(spark, sf):
    """Every test vector claims one identity: its own or, for every other one, another's."""
    e = table(spark, sf, "embeddings").withColumn("enrol", uniform("e", F.col("vec_id")) < 0.5)
    centroids = m.vector_means(e.filter("enrol"), ["label"], "embedding").withColumnRenamed("label", "claimed")
    vec = F.col("vec_id")
    impostor = ((F.col("label") + 1 + F.floor(vec / 2) % 9) % 10).cast("int")
    claims = e.filter("NOT enrol").withColumn("claimed", F.when(vec % 2 == 0, F.col("label")).otherwise(impostor))
    return claims.join(centroids, "claimed").select(
        "vec_id", "claimed", cosine(F.col("embedding"), F.col("centroid")).alias("score"),
        (F.col("claimed") == F.col("label")).alias("positive"), F.lit("cosine").alias("detector"))


@query("embedding_verification", f"WITH {_EMB}, {_AUC.format(src='SELECT detector, score, p FROM et', keys='detector')}, {_DET} SELECT {r('eer', 'eer')}, {r('threshold', 'threshold')} FROM eer")
def embedding_verification(spark, sf):
    t = embedding_trials(spark, sf)
    n = table_slices(spark, sf, "embeddings")
    return rounded(m.equal_error_rate(m.det_points(m.threshold_counts(t, [], n), []), [], n))


# ---------------------------------------------------------------- risk
_PROB = """
pd AS (SELECT 's' || (doc_id % 50) AS session_id, detector, CASE WHEN detector <> 'length' THEN least(0.999, greatest(0.001, avg(score))) END AS p FROM sc GROUP BY 1, 2),
lo AS (SELECT *, ln(p / (1 - p)) AS lg FROM pd WHERE p IS NOT NULL)"""


def probabilities(spark, sf):
    s = scores(spark, sf).groupBy(F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session_id"), "detector").agg(F.avg("score").alias("p"))
    return s.withColumn("p", F.when(F.col("detector") != "length", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("p")))))


@query("log_odds", sc_sql(f"SELECT session_id, detector, {r('lg', 'log_odds')}, {r('1 / (1 + exp(-lg))', 'back')} FROM lo", _PROB))
def log_odds(spark, sf):
    from ..functions.exprs import logit, sigmoid
    p = probabilities(spark, sf).filter("p IS NOT NULL").withColumn("log_odds", logit(F.col("p"), 1e-12))
    return rounded(p.select("session_id", "detector", "log_odds", sigmoid(F.col("log_odds")).alias("back")))


@query("combined_risk", sc_sql(f"SELECT session_id, {r('1 / (1 + exp(-(ln(0.05::DOUBLE / 0.95::DOUBLE) + sum(lg))))', 'risk')} FROM lo GROUP BY 1", _PROB))
def combined_risk(spark, sf):
    return rounded(rk.combined_risk(probabilities(spark, sf)))


@query("risk_explanation", sc_sql(f"SELECT session_id, detector, {r('lg', 'log_odds')} FROM lo", _PROB))
def risk_explanation(spark, sf):
    e = rk.explain_risk(probabilities(spark, sf))
    return rounded(e.select("session_id", F.explode("contributions").alias("detector", "log_odds")))


_UNITS = """
un AS (SELECT 's' || (doc_id % 50) AS session_id, doc_id AS unit_idx, detector, CASE detector WHEN 'hash' THEN 'chunk' ELSE 'window' END AS grain, score, toxic = 1 AS contains_cheat FROM sc)"""


def units(spark, sf):
    return scores(spark, sf).select(
        F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session_id"), F.col("doc_id").alias("unit_idx"), "detector",
        F.when(F.col("detector") == "hash", "chunk").otherwise("window").alias("grain"), "score", (F.col("toxic") == 1).alias("contains_cheat"))


@query("session_scores", sc_sql(f"""
  SELECT session_id, detector, {r("CASE any_value(grain) WHEN 'chunk' THEN quantile_cont(score, 0.95) ELSE max(score) END", 'score')} FROM un GROUP BY 1, 2""", _UNITS))
def session_scores(spark, sf):
    return rounded(rk.session_scores(units(spark, sf), table_slices(spark, sf, "labels")))


@query("alternative_rollups", sc_sql(f"""
  SELECT session_id, detector, {r('avg(score) FILTER (rn <= 3)', 'top_mean')}, {r('avg((score > 0.6)::INT)', 'share_above')} FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, detector ORDER BY score DESC, unit_idx DESC) AS rn FROM un) GROUP BY 1, 2""", _UNITS))
def alternative_rollups(spark, sf):
    return rounded(rk.alternative_rollups(units(spark, sf), 3, 0.6, table_slices(spark, sf, "labels"), ("session_id", "detector")))


@query("flag_rates", sc_sql(f"""
  SELECT session_id, detector, count(*) AS chunks, {r('avg((score > lim)::INT) FILTER (contains_cheat)', 'hit_rate')}, {r('avg((score > lim)::INT) FILTER (NOT contains_cheat)', 'false_flag_rate')}
  FROM un JOIN (SELECT detector, quantile_cont(score, 0.95) AS lim FROM un WHERE NOT contains_cheat GROUP BY 1) USING (detector) GROUP BY 1, 2""", _UNITS))
def flag_rates(spark, sf):
    return rounded(rk.flag_rates(units(spark, sf), slices=table_slices(spark, sf, "labels"), by=("detector",)))


@query("isotonic_calibration")
def isotonic_calibration(spark, sf):
    s = scores(spark, sf).select("doc_id", "detector", "score", F.col("toxic").cast("double").alias("label"))
    knots = rk.fit_isotonic_per_detector(s, ["length", "hash", "coarse"])
    return rounded(rk.apply_isotonic(s, knots, table_slices(spark, sf, "labels")))


@query("calibrator_comparison")
def calibrator_comparison(spark, sf):
    """Platt against isotonic on a held-out half: Brier score per method."""
    s = scores(spark, sf).filter("detector = 'hash'").select("doc_id", "detector", "score", F.col("toxic").cast("double").alias("label"))
    n = table_slices(spark, sf, "labels")
    parts = sp.stratified_half(s, "label", "doc_id", slices=n)
    fit, test = parts.filter("part = 'fit'"), parts.filter("part = 'test'").drop("part")
    knots = rk.fit_isotonic(fit).withColumn("detector", F.lit("hash"))
    slope, intercept = rk.platt(fit)
    iso = rk.apply_isotonic(test, knots, n).select("label", "p", F.lit("isotonic").alias("method"))
    pla = test.select("label", rk.apply_platt(F.col("score"), slope, intercept).alias("p"), F.lit("platt").alias("method"))
    return rounded(iso.unionByName(pla).groupBy("method").agg(
        F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2))).alias("brier"), F.count(F.lit(1)).alias("n")))


@query("combined_against_single")
def combined_against_single(spark, sf):
    """Calibrate on one half, then compare the combined risk with every detector on the other."""
    s = scores(spark, sf).select("doc_id", "detector", "score", F.col("toxic").cast("double").alias("label"))
    n = table_slices(spark, sf, "labels")
    ids = sp.stratified_half(s.select("doc_id", "label").distinct(), "label", "doc_id", slices=n).select("doc_id", "part")
    parts = s.join(ids, "doc_id")
    knots = rk.fit_isotonic_per_detector(parts.filter("part = 'fit'"), ["length", "hash", "coarse"])
    test = parts.filter("part = 'test'").drop("part")
    cal = rk.apply_isotonic(test, knots, n)
    risk = rk.combined_risk(cal, keys=("doc_id", "label")).select("doc_id", "label", F.lit("combined").alias("detector"), F.col("risk").alias("score"))
    pool = test.unionByName(risk).withColumn("positive", F.col("label") == 1)
    return rounded(m.roc_auc(pool, ["detector"], n))


# ---------------------------------------------------------------- splits
def sql_rank(seed: str, ident: str) -> str:
    return f"('0x' || substr(md5({seed} || '|' || {ident}), 1, 15))::BIGINT, {ident}"


_SPLIT = f"""
lg AS (SELECT session_id, player, row_number() OVER (PARTITION BY player ORDER BY {sql_rank("'42'", 'session_id')}) - 1 AS rnk, count(*) OVER (PARTITION BY player) AS n
       FROM sess WHERE NOT is_cheat_session),
sz AS (SELECT *, CASE WHEN n >= 2 THEN greatest(1, round_even(n * 0.2, 0)::BIGINT) ELSE 0 END AS te0, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15, 0)::BIGINT) ELSE 0 END AS va0 FROM lg WHERE n >= 2),
ex AS (SELECT *, greatest(0, te0 + va0 - (n - 1)) AS x FROM sz),
sp AS (SELECT *, va0 - least(va0, x) AS va, greatest(0, te0 - (x - least(va0, x))) AS te FROM ex),
folds AS (SELECT session_id, player, CASE WHEN rnk < te THEN 'test' WHEN rnk < te + va THEN 'val' ELSE 'train' END AS fold FROM sp)"""


def folds(tele):
    return sp.stratified_sessions(tele.sessions, 0.2, 0.15, 2, slices=tele.slices)


@query("session_split", with_sql("sessions", _SPLIT.strip(), "SELECT session_id, player, fold FROM folds"))
def session_split(spark, sf):
    return folds(telemetry(spark, sf))


@query("split_leakage", with_sql("sessions", _SPLIT.strip(), """
  SELECT count(*) AS leaking FROM (SELECT session_id FROM folds GROUP BY 1 HAVING count(DISTINCT fold) > 1)"""))
def split_leakage(spark, sf):
    return sp.leaking_sessions(folds(telemetry(spark, sf))).agg(F.count(F.lit(1)).alias("leaking"))


@query("windows_per_fold", with_sql("features", _SPLIT.strip(), "SELECT f.player, fold, count(*) AS windows FROM feat f JOIN folds USING (session_id) GROUP BY 1, 2"))
def windows_per_fold(spark, sf):
    return st.windows_per_fold(feature_table(spark, sf), folds(telemetry(spark, sf)))


@query("stratified_half", sc_sql("SELECT label, doc_id, CASE WHEN rnk < n // 2 THEN 'fit' ELSE 'test' END AS part FROM hf", f"""
  hf AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY {sql_rank("'0'", 'doc_id')}) - 1 AS rnk, count(*) OVER (PARTITION BY label) AS n FROM base)"""))
def stratified_half(spark, sf):
    s = scores(spark, sf).filter("detector = 'hash'").select("label", "doc_id")
    return sp.stratified_half(s, "label", "doc_id", slices=table_slices(spark, sf, "labels"))


@query("last_share_split", sessions_sql("""
  SELECT session_id, player, CASE WHEN rn > n - greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM (
    SELECT session_id, player, row_number() OVER (PARTITION BY player ORDER BY session_id) AS rn, count(*) OVER (PARTITION BY player) AS n FROM sess)"""))
def last_share_split(spark, sf):
    tele = telemetry(spark, sf)
    return sp.last_share(tele.sessions.select("session_id", "player"), "player", 0.2, tele.slices)


@query("temporal_split", events_sql("""
  SELECT session_id, seq, CASE WHEN seq < floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM (
    SELECT session_id, seq, count(*) OVER (PARTITION BY session_id) AS n FROM ev) WHERE seq < floor(n * 0.7) OR seq >= floor(n * 0.7) + 1"""))
def temporal_split(spark, sf):
    tele = telemetry(spark, sf)
    return sp.temporal_split(tele.events.select("session_id", "seq", "t"), ["session_id"], ["t", "seq"], slices=tele.slices).drop("t")


@query("protocol_split", sessions_sql("""
  SELECT session_id, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS part FROM sess WHERE user_id % 3 < 2"""))
def protocol_split(spark, sf):
    u = F.col("user_id") % 3
    name = F.concat("session_id", F.when(u == 0, "_3min").when(u == 1, "_1min").otherwise("_free"))
    s = telemetry(spark, sf).sessions.select("session_id", F.regexp_extract(name, "(1min|3min)", 1).alias("protocol"))
    return sp.protocol_split(s).drop("protocol")


_ALL_RANK = "SELECT user_id, row_number() OVER (ORDER BY {}) - 1 AS rnk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)"


@query("disjoint_manifest", f"""
  SELECT user_id, rnk AS rank, CASE WHEN rnk < floor(n * 0.8) THEN 'train' WHEN rnk < floor(n * 0.9) THEN 'val' ELSE 'test' END AS fold,
    rnk < floor(n * 0.8) AND rnk < 20 AS subset_20, rnk < floor(n * 0.8) AND rnk < 50 AS subset_50 FROM ({_ALL_RANK.format(sql_rank("'42'", 'user_id'))})""")
def disjoint_manifest(spark, sf):
    ids = table(spark, sf, "events").select("user_id")
    return sp.disjoint_manifest(ids, "user_id", (0.8, 0.1), (20, 50), slices=table_slices(spark, sf, "events"))


@query("random_subsets", f"""
  SELECT draw::INT AS draw, user_id FROM (SELECT d.draw, user_id, row_number() OVER (PARTITION BY d.draw ORDER BY {sql_rank("'0:' || d.draw", 'user_id')}) AS rn
    FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS draw) d) WHERE rn <= 10""")
def random_subsets(spark, sf):
    return sp.random_subsets(table(spark, sf, "events").select("user_id"), "user_id", 10, 5, slices=table_slices(spark, sf, "events"))


@query("open_set_split", f"SELECT user_id, rnk < n // 2 AS enrolled FROM ({_ALL_RANK.format(sql_rank(repr('0'), 'user_id'))})")
def open_set_split(spark, sf):
    return sp.open_set(table(spark, sf, "events").select("user_id"), "user_id", slices=table_slices(spark, sf, "events"))


@query("player_holdout", f"SELECT user_id, CASE WHEN rnk < greatest(1, floor(n * 0.3)) THEN 'test' ELSE 'train' END AS part FROM ({_ALL_RANK.format(sql_rank(repr('0'), 'user_id'))})")
def player_holdout(spark, sf):
    return sp.held_out_ids(table(spark, sf, "events").select("user_id"), "user_id", 0.3, slices=table_slices(spark, sf, "events"))


@query("bounded_sample", f"SELECT event_id FROM events ORDER BY {sql_rank(repr('0'), 'event_id')} LIMIT 200")
def bounded_sample(spark, sf):
    """The sampling operator itself: 200 events with the smallest keyed hash."""
    return sp.bounded_sample(table(spark, sf, "events").select("event_id"), "event_id", 200)


@query("balanced_first", sc_sql("SELECT label, doc_id FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM base) WHERE rn <= 10"))
def balanced_first(spark, sf):
    s = scores(spark, sf).filter("detector = 'hash'").select("label", "doc_id")
    return sp.balanced_first(s, "label", "doc_id", 10, table_slices(spark, sf, "labels"))


@query("known_unknown_users", f"""
  SELECT e.enrolled, count(*) AS events FROM events v JOIN (SELECT user_id, rnk < n // 2 AS enrolled FROM ({_ALL_RANK.format(sql_rank(repr('0'), 'user_id'))})) e USING (user_id) GROUP BY 1""")
def known_unknown_users(spark, sf):
    """Semi and anti join against the enrolled half."""
    from ..operators.joins import keep_known, keep_unknown
    ev = table(spark, sf, "events").select("user_id")
    known = sp.open_set(ev, "user_id", slices=table_slices(spark, sf, "events")).filter("enrolled")
    count = F.count(F.lit(1)).alias("events")
    return keep_known(ev, known, "user_id").agg(count).withColumn("enrolled", F.lit(True)).unionByName(
        keep_unknown(ev, known, "user_id").agg(count).withColumn("enrolled", F.lit(False)))


@query("label_join", """
  SELECT source, coalesce(toxic, -1)::INT AS is_illegal, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def label_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    j = d.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return j.groupBy("source", F.coalesce("toxic", F.lit(-1)).cast("int").alias("is_illegal")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- profiles and summaries
@query("player_profiles", with_sql("features", "pm AS (" + " UNION ALL ".join(
    f"SELECT player, '{c}' AS feature, avg({c}) AS mean FROM feat GROUP BY 1" for c in FEATURES) + ")", f"""
  SELECT player, feature, round(mean::DOUBLE, CASE feature WHEN 'mouse_key_ratio' THEN 1 ELSE 7 END) + 0.0 AS mean,
    {r('(mean - min(mean) OVER f) / CASE WHEN max(mean) OVER f = min(mean) OVER f THEN 1 ELSE max(mean) OVER f - min(mean) OVER f END', 'scaled')},
    {r('(mean - avg(mean) OVER f) / nullif(stddev_samp(mean) OVER f, 0)', 'z')} FROM pm WINDOW f AS (PARTITION BY feature)"""))
def player_profiles(spark, sf):
    p = rounded(st.player_profiles(feature_table(spark, sf), FEATURES).withColumns(
        {"scaled": F.round("scaled", 6), "z": F.round("z", 6)}), 7)
    return p.withColumn("mean", F.when(F.col("feature") == "mouse_key_ratio", F.round("mean", 1)).otherwise(F.col("mean")))


@query("session_fingerprint", with_sql("features", "sm AS (" + " UNION ALL ".join(
    f"SELECT session_id, '{c}' AS feature, avg({c}) AS value FROM feat GROUP BY 1" for c in FEATURES) + """),
  md AS (SELECT feature, median(value) AS md FROM sm GROUP BY 1 HAVING avg((value IS NOT NULL)::INT) > 0.2),
  fi AS (SELECT session_id, feature, coalesce(value, md) AS v FROM sm JOIN md USING (feature))""", f"""
  SELECT session_id, feature, {r('(v - avg(v) OVER f) / nullif(stddev_pop(v) OVER f, 0)', 'z', 5)} FROM fi WINDOW f AS (PARTITION BY feature)"""))
def session_fingerprint(spark, sf):
    tele_n = table_slices(spark, sf, "events")
    return rounded(st.session_fingerprint(feature_table(spark, sf), FEATURES, slices=tele_n), 5)


_IDS = """
nm AS (SELECT DISTINCT 'm' || (o_custkey % 40) AS match_id, CASE WHEN (o_custkey % 40) % 3 = 0 THEN 'Player_' || (o_custkey % 11) WHEN (o_custkey % 40) % 3 = 1 THEN '76561190000' || lpad((o_custkey)::VARCHAR, 6, '0') ELSE 'nick' || o_custkey END AS player FROM orders)"""


def match_players(spark, sf):
    k = F.col("o_custkey")
    mod = (k % 40) % 3
    name = (F.when(mod == 0, F.concat(F.lit("Player_"), (k % 11).cast("string")))
            .when(mod == 1, F.concat(F.lit("76561190000"), F.lpad(k.cast("string"), 6, "0")))
            .otherwise(F.concat(F.lit("nick"), k.cast("string"))))
    return table(spark, sf, "orders").select(F.concat(F.lit("m"), (k % 40).cast("string")).alias("match_id"), name.alias("player"))


@query("identity_schemes", f"""WITH {_IDS}
  SELECT match_id, count(*) AS players, CASE WHEN bool_and(regexp_matches(player, '^7656119\\d{{10}}$')) THEN 'steam64' WHEN avg(regexp_matches(player, '^Player_\\d+$')::INT) >= 0.8 THEN 'generic' ELSE 'mixed' END AS scheme
  FROM nm GROUP BY 1""")
def identity_schemes(spark, sf):
    return st.identity_schemes(match_players(spark, sf))


@query("identity_verdict", f"WITH {_IDS} SELECT count(DISTINCT player) AS distinct_players, CASE WHEN count(DISTINCT player) <= 16 THEN 'THIN' ELSE 'DIVERSE' END AS verdict FROM nm")
def identity_verdict(spark, sf):
    return st.identity_verdict(match_players(spark, sf))


_RUNS = f"""
rn AS (SELECT p_partkey AS run_id, p_type AS init, p_size AS budget, {DRAW.format("'run|' || p_partkey")} AS auc, p_brand AS cheat, (p_size % 5) / 4.0::DOUBLE AS lam, {DRAW.format("'ut|' || p_partkey")} AS utility FROM part)"""


def runs(spark, sf):
    """Result table of many runs, one per part."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("run_id"), F.col("p_type").alias("init"), F.col("p_size").alias("budget"), uniform("run", p).alias("auc"),
        F.col("p_brand").alias("cheat"), ((F.col("p_size") % 5) / 4.0).alias("lambda"), uniform("ut", p).alias("utility"))


@query("budget_curve", f"WITH {_RUNS} SELECT init, budget, {r('avg(auc)', 'auc_mean')}, {r('stddev_pop(auc)', 'auc_std')}, count(*) AS runs FROM rn GROUP BY 1, 2")
def budget_curve(spark, sf):
    return rounded(m.budget_curve(runs(spark, sf)))


@query("best_run", f"WITH {_RUNS} SELECT arg_max(run_id, (floor(auc * 20), -run_id)) AS run_id, {r('max(floor(auc * 20))', 'auc')} FROM rn")
def best_run(spark, sf):
    coarse = runs(spark, sf).withColumn("auc", F.floor(F.col("auc") * 20).cast("double"))
    return rounded(m.best_run(coarse, "auc", "run_id"))


@query("frontier_summary", f"""WITH {_RUNS}, pc AS (SELECT cheat, lam, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, avg(utility) AS utility FROM rn GROUP BY 1, 2)
  SELECT p.cheat, {r('p.lam', 'lambda')}, {r('auc_mean', 'auc_mean')}, {r('auc_std', 'auc_std')}, {r('utility', 'utility')}, {r('b', 'break_lambda')}
  FROM pc p LEFT JOIN (SELECT cheat, min(lam) AS b FROM pc WHERE utility <= 0.45 GROUP BY 1) z ON z.cheat = p.cheat""")
def frontier_summary(spark, sf):
    return rounded(m.frontier(runs(spark, sf), 0.45))
