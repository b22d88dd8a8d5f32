"""Queries of the forecast stage: breaks, models, backtest, final forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r2, r4, rnd
from ..operators import backtest as BT
from ..operators import breaks as BK
from ..operators import forecast as FC
from ..operators import metrics as M
from ..operators import models as MD
from ..operators.ranges import quantiles
from .catalog import register

from .sqlparts import with_panel
from .stages import stages_for
from .holt_sql import holt_sql

KEYS = ["entity", "category"]

# ------------------------------------------------------------ SQL builders
TRI = """, tr AS (
  SELECT *, min(CASE WHEN value > 0 THEN t END) OVER (PARTITION BY entity, category) AS t_first FROM panel),
tri AS (
  SELECT entity, region, category, t, value, t_first, t - t_first AS i,
         count(*) OVER (PARTITION BY entity, category) AS n
  FROM tr WHERE t >= t_first)"""


def ols_sql(name, src, x="i"):
    """CTE ``name``: n, sums, slope b and intercept a of value on ``x``."""
    return f""", {name}_s AS (
  SELECT entity, category, count(*) AS n, CAST(sum({x}) AS DOUBLE) AS st, CAST(sum({x} * {x}) AS DOUBLE) AS stt,
    CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS sy,
    CAST(sum(CAST(value AS DECIMAL(20,2)) * {x}) AS DOUBLE) AS sty
  FROM {src} GROUP BY 1, 2),
{name}_b AS (SELECT *, CASE WHEN n >= 2 AND n * stt - st * st <> 0
                       THEN (n * sty - st * sy) / (n * stt - st * st) ELSE 0.0 END AS b FROM {name}_s),
{name} AS (SELECT *, (sy - b * st) / n AS a FROM {name}_b)"""


def naive_sql(name, hist, h=5):
    """CTE ``name``(entity, category, step, f, lo, hi) from ``hist``(entity, category, i, value)."""
    return f""", {name}_d AS (
  SELECT *, value - lag(value) OVER (PARTITION BY entity, category ORDER BY i) AS d FROM {hist}),
{name}_g AS (SELECT entity, category, arg_min(value, i) AS y1, arg_max(value, i) AS yn, count(*) AS n,
                    stddev_pop(d) AS sd FROM {name}_d GROUP BY 1, 2),
{name}_x AS (SELECT entity, category, CAST(r.step AS INTEGER) AS step,
                    yn + r.step * CASE WHEN n > 1 THEN (yn - y1) / (n - 1) ELSE 0.0 END AS f,
                    1.28 * sd * sqrt(r.step) AS sp
             FROM {name}_g, range(1, {h + 1}) r(step)),
{name} AS (SELECT entity, category, step, f, f - sp AS lo, f + sp AS hi FROM {name}_x)"""


def linear_sql(name, hist, h=5, x="i"):
    return ols_sql(f"{name}_o", hist, x) + f""", {name}_r AS (
  SELECT o.entity, o.category, stddev_pop(hh.value - (o.a + o.b * hh.{x})) AS sd
  FROM {hist} hh JOIN {name}_o o ON hh.entity = o.entity AND hh.category = o.category GROUP BY 1, 2),
{name}_x AS (SELECT o.entity, o.category, CAST(r.step AS INTEGER) AS step, o.a + o.b * (o.n - 1 + r.step) AS f,
                    1.28 * rr.sd * sqrt(1 + 1 / o.n) AS sp
             FROM {name}_o o JOIN {name}_r rr ON o.entity = rr.entity AND o.category = rr.category,
                  range(1, {h + 1}) r(step)),
{name} AS (SELECT entity, category, step, f, f - sp AS lo, f + sp AS hi FROM {name}_x)"""


def segmented_sql(name, hist, bp, h=5):
    """``bp``(entity, category, bp_idx) may lack series or hold NULL."""
    return f""", {name}_l AS (SELECT entity, category, count(*) AS len FROM {hist} GROUP BY 1, 2),
{name}_f AS (
  SELECT l.entity, l.category,
    CASE WHEN bp.bp_idx IS NOT NULL AND bp.bp_idx >= 0 AND bp.bp_idx <= l.len - 4 AND l.len - bp.bp_idx >= 4
         THEN bp.bp_idx ELSE 0 END AS fr
  FROM {name}_l l LEFT JOIN {bp} bp ON bp.entity = l.entity AND bp.category = l.category),
{name}_h AS (SELECT hh.entity, hh.category, hh.i - f.fr AS x, hh.value FROM {hist} hh
             JOIN {name}_f f ON hh.entity = f.entity AND hh.category = f.category WHERE hh.i >= f.fr)""" \
        + linear_sql(name, f"{name}_h", h, x="x")


BREAKS = TRI + """, st0 AS (
  SELECT entity, category, count(*) AS n, min(t_first) AS t_first, min(value) = max(value) AS flat,
    CAST(sum(t) AS DOUBLE) AS st, CAST(sum(t * t) AS DOUBLE) AS stt,
    CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS sy, CAST(sum(CAST(value AS DECIMAL(20,2)) * t) AS DOUBLE) AS sty
  FROM tri GROUP BY 1, 2),
stf AS (SELECT *, CASE WHEN n >= 2 AND n * stt - st * st <> 0 THEN (n * sty - st * sy) / (n * stt - st * st)
                  ELSE 0.0 END AS full_slope FROM st0),
el AS (SELECT entity, category, n - 1 AS m FROM stf WHERE n >= 10 AND NOT flat),
dd AS (SELECT tri.*, CAST(value AS DECIMAL(20,2))
          - lag(CAST(value AS DECIMAL(20,2))) OVER (PARTITION BY entity, category ORDER BY i) AS d
       FROM tri WHERE (entity, category) IN (SELECT (entity, category) FROM el)),
pref AS (SELECT entity, category, i,
    value - first_value(value) OVER (PARTITION BY entity, category ORDER BY i) AS p1,
    CAST(coalesce(sum(d * d) OVER (PARTITION BY entity, category ORDER BY i
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS DOUBLE) AS p2
  FROM dd),
seg AS (
  SELECT a.entity, a.category, a.i AS s, b.i AS t,
         (b.p2 - a.p2) - (b.p1 - a.p1) * (b.p1 - a.p1) / (b.i - a.i) AS c
  FROM pref a JOIN pref b ON a.entity = b.entity AND a.category = b.category AND b.i - a.i >= 5
  JOIN el ON el.entity = a.entity AND el.category = a.category
  WHERE (a.i = 0 OR a.i >= 5) AND (b.i = el.m OR b.i <= el.m - 5)),
chain(entity, category, last, total, bps) AS (
  SELECT entity, category, 0, CAST(-3.0 AS DOUBLE), CAST([] AS INTEGER[]) FROM el
  UNION ALL
  SELECT c.entity, c.category, g.t, c.total + g.c + CAST(3.0 AS DOUBLE),
         CASE WHEN g.t < el.m THEN list_append(c.bps, CAST(g.t AS INTEGER)) ELSE c.bps END
  FROM chain c JOIN seg g ON g.entity = c.entity AND g.category = c.category AND g.s = c.last
  JOIN el ON el.entity = c.entity AND el.category = c.category
  WHERE c.last < el.m),
optseg AS (SELECT c.entity, c.category, arg_min(bps, total) AS breakpoints
           FROM chain c JOIN el ON el.entity = c.entity AND el.category = c.category AND c.last = el.m
           GROUP BY 1, 2),
cand AS (SELECT o.entity, o.category, el.m, unnest(o.breakpoints) AS b FROM optseg o
         JOIN el ON el.entity = o.entity AND el.category = o.category),
sc0 AS (
  SELECT c.entity, c.category, c.b,
    count(CASE WHEN i <= b THEN 1 END) AS a_n,
    CAST(sum(CASE WHEN i <= b THEN t END) AS DOUBLE) AS a_st,
    CAST(sum(CASE WHEN i <= b THEN t * t END) AS DOUBLE) AS a_stt,
    CAST(sum(CASE WHEN i <= b THEN CAST(value AS DECIMAL(20,2)) END) AS DOUBLE) AS a_sy,
    CAST(sum(CASE WHEN i <= b THEN CAST(value AS DECIMAL(20,2)) * t END) AS DOUBLE) AS a_sty,
    count(CASE WHEN i > b THEN 1 END) AS z_n,
    CAST(sum(CASE WHEN i > b THEN t END) AS DOUBLE) AS z_st,
    CAST(sum(CASE WHEN i > b THEN t * t END) AS DOUBLE) AS z_stt,
    CAST(sum(CASE WHEN i > b THEN CAST(value AS DECIMAL(20,2)) END) AS DOUBLE) AS z_sy,
    CAST(sum(CASE WHEN i > b THEN CAST(value AS DECIMAL(20,2)) * t END) AS DOUBLE) AS z_sty
  FROM cand c JOIN tri ON tri.entity = c.entity AND tri.category = c.category
  WHERE c.b >= 5 AND c.b <= c.m - 5 GROUP BY 1, 2, 3),
sc1 AS (SELECT entity, category, b,
  CASE WHEN a_n >= 2 AND a_n * a_stt - a_st * a_st <> 0
       THEN (a_n * a_sty - a_st * a_sy) / (a_n * a_stt - a_st * a_st) ELSE 0.0 END AS pre_slope,
  CASE WHEN z_n >= 2 AND z_n * z_stt - z_st * z_st <> 0
       THEN (z_n * z_sty - z_st * z_sy) / (z_n * z_stt - z_st * z_st) ELSE 0.0 END AS post_slope
  FROM sc0),
sc2 AS (SELECT *, CASE WHEN abs(pre_slope) < 1 THEN abs(post_slope - pre_slope)
                       ELSE abs((post_slope - pre_slope) / pre_slope) * 100 END AS chg FROM sc1),
bestb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, category ORDER BY chg DESC, b) AS rk
                         FROM sc2 WHERE chg > 0) WHERE rk = 1 AND chg >= 30),
breaks AS (
  SELECT s.entity, s.category,
    CAST(CASE WHEN bb.b IS NOT NULL THEN s.t_first + bb.b + 1 END AS INTEGER) AS breakpoint_t,
    CASE WHEN bb.b IS NOT NULL THEN bb.pre_slope ELSE s.full_slope END AS pre_slope,
    CASE WHEN bb.b IS NOT NULL THEN bb.post_slope ELSE s.full_slope END AS post_slope,
    CASE WHEN bb.b IS NOT NULL THEN bb.chg ELSE 0.0 END AS slope_change_pct,
    CASE WHEN bb.b IS NULL THEN 'none'
         WHEN (bb.pre_slope > 0 AND bb.post_slope < 0) OR (bb.pre_slope < 0 AND bb.post_slope > 0) THEN 'reversal'
         WHEN bb.chg > 100 THEN 'strong' WHEN bb.chg > 50 THEN 'moderate' ELSE 'mild' END AS significance,
    CAST(s.n AS INTEGER) AS n_observations, s.t_first
  FROM stf s LEFT JOIN bestb bb ON bb.entity = s.entity AND bb.category = s.category)"""


def _breaks(spark, sf):
    return stages_for(spark, sf).breaks


@register("structural_breaks", with_panel(BREAKS + """
SELECT entity, category, breakpoint_t, round(pre_slope, 4) AS pre_slope, round(post_slope, 4) AS post_slope,
       round(slope_change_pct, 4) AS slope_change_pct, significance, n_observations FROM breaks""",
                                          recursive=True))
def q_structural_breaks(spark, sf):
    b = _breaks(spark, sf)
    return b.select(*KEYS, "breakpoint_t", *[r4(c).alias(c) for c in ("pre_slope", "post_slope",
                                                                          "slope_change_pct")],
                    "significance", "n_observations")


@register("segment_series", with_panel(BREAKS + """
SELECT entity, category, breakpoints FROM optseg""", recursive=True))
def q_segment_series(spark, sf):
    p = stages_for(spark, sf).panel
    tr = BT.indexed(p, KEYS)
    stats = tr.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.min("value") == F.max("value")).alias("flat"))
    el = stats.filter((F.col("n") >= 10) & ~F.col("flat")).select(*KEYS)
    return BK.segment_series(tr.join(el, KEYS, "left_semi"), KEYS).select(*KEYS, "breakpoints")


@register("break_counts", with_panel(BREAKS + """
SELECT count(*) FILTER (WHERE breakpoint_t IS NOT NULL) AS n_with_break,
       count(*) FILTER (WHERE breakpoint_t IS NULL) AS n_without_break FROM breaks""", recursive=True))
def q_break_counts(spark, sf):
    b = _breaks(spark, sf)
    return b.agg(F.count_if(F.col("breakpoint_t").isNotNull()).alias("n_with_break"),
                 F.count_if(F.col("breakpoint_t").isNull()).alias("n_without_break"))


@register("break_catalog", with_panel(BREAKS + """
SELECT b.entity, b.category, tri.t, round(tri.value, 2) AS value,
       tri.t <= b.breakpoint_t AS in_pre, tri.t >= b.breakpoint_t AS in_post
FROM breaks b JOIN tri ON tri.entity = b.entity AND tri.category = b.category
WHERE b.breakpoint_t IS NOT NULL""", recursive=True))
def q_break_catalog(spark, sf):
    """Series split at the break period (the break point is in both)."""
    st = stages_for(spark, sf)
    p = st.panel
    b = st.breaks.filter(F.col("breakpoint_t").isNotNull())
    tr = BT.indexed(p, KEYS)
    j = b.select(*KEYS, "breakpoint_t").join(tr, KEYS)
    return j.select(*KEYS, "t", r2("value").alias("value"), (F.col("t") <= F.col("breakpoint_t")).alias("in_pre"),
                    (F.col("t") >= F.col("breakpoint_t")).alias("in_post"))


# ------------------------------------------------------------ single models on the full series
FULL = TRI + """, full8 AS (SELECT entity, category, i, value FROM tri WHERE n >= 8)"""


def _fc_out(df):
    # four decimals: fits of a few two-decimal values fall on half cents
    return df.select(*KEYS, "step", r4("forecast").alias("forecast"), r4("lower_80").alias("lower_80"),
                     r4("upper_80").alias("upper_80"))


FC_SELECT = """
SELECT entity, category, step, round(f, 4) AS forecast, round(lo, 4) AS lower_80, round(hi, 4) AS upper_80 FROM fc"""


def _full_hist(spark, sf):
    s = BT.indexed(stages_for(spark, sf).panel, KEYS).filter(F.col("n") >= 8)
    return s.select(*KEYS, "i", "value")


@register("fc_naive", with_panel(FULL + naive_sql("fc", "full8") + FC_SELECT))
def q_fc_naive(spark, sf):
    return _fc_out(MD.naive_drift(_full_hist(spark, sf), 5, KEYS))


@register("fc_linear", with_panel(FULL + linear_sql("fc", "full8") + FC_SELECT))
def q_fc_linear(spark, sf):
    return _fc_out(MD.linear_trend(_full_hist(spark, sf), 5, KEYS))


@register("fc_segmented", with_panel(BREAKS + """, full8 AS (SELECT entity, category, i, value FROM tri WHERE n >= 8),
bpi AS (SELECT entity, category, breakpoint_t - t_first AS bp_idx FROM breaks)"""
                                     + segmented_sql("fc", "full8", "bpi") + FC_SELECT, recursive=True))
def q_fc_segmented(spark, sf):
    st = stages_for(spark, sf)
    p, b = st.panel, st.breaks
    s = BT.indexed(p, KEYS).filter(F.col("n") >= 8)
    info = s.groupBy(*KEYS).agg(F.min("t_first").alias("t_first"))
    bp = b.join(info, KEYS).select(*KEYS, (F.col("breakpoint_t") - F.col("t_first")).alias("bp_idx"))
    return _fc_out(MD.segmented(s.select(*KEYS, "i", "value"), 5, KEYS, bp))


@register("fc_holt", with_panel(FULL + holt_sql("fc", "full8") + FC_SELECT, recursive=True))
def q_fc_holt(spark, sf):
    return _fc_out(MD.holt(_full_hist(spark, sf), 5, KEYS))


@register("holt_params", with_panel(FULL + holt_sql("hp", "full8") + """
SELECT f.entity, f.category, f.alpha, f.beta, round(f.lv, 2) AS level, round(f.tr, 2) AS trend, round(f.sd, 2) AS sd,
       CAST(n.n AS INTEGER) AS n
FROM hp_fin f JOIN hp_n n ON n.entity = f.entity AND n.category = f.category""", recursive=True))
def q_holt_params(spark, sf):
    g = MD.holt_params(_full_hist(spark, sf), KEYS)
    return g.select(*KEYS, "alpha", "beta", r2("level").alias("level"), r2("trend").alias("trend"),
                    r2("sd").alias("sd"), "n")


# ------------------------------------------------------------ backtest
BT_SQL = BREAKS + """, bt AS (SELECT * FROM tri WHERE n >= 13),
train AS (SELECT entity, category, i, value FROM bt WHERE i < n - 5),
test AS (SELECT entity, category, CAST(i - (n - 5) + 1 AS INTEGER) AS step, value AS actual FROM bt WHERE i >= n - 5),
btinfo AS (SELECT entity, category, min(t_first) AS t_first, max(n) AS n FROM bt GROUP BY 1, 2),
tbp AS (SELECT bi.entity, bi.category, CAST(b.breakpoint_t - bi.t_first AS INTEGER) AS bp_idx
        FROM btinfo bi JOIN breaks b ON b.entity = bi.entity AND b.category = bi.category
        WHERE b.breakpoint_t IS NOT NULL AND b.breakpoint_t - bi.t_first > 0
          AND b.breakpoint_t - bi.t_first < bi.n - 5 - 4),
train_seg AS (SELECT * FROM train WHERE (entity, category) IN (SELECT (entity, category) FROM tbp))""" \
    + naive_sql("p_naive", "train") + linear_sql("p_lin", "train") + segmented_sql("p_seg", "train_seg", "tbp") \
    + holt_sql("p_holt", "train") + """, preds AS (
  SELECT entity, category, step, f, 'naive_drift' AS model FROM p_naive
  UNION ALL SELECT entity, category, step, f, 'linear_trend' FROM p_lin
  UNION ALL SELECT entity, category, step, f, 'segmented' FROM p_seg
  UNION ALL SELECT entity, category, step, f, 'holt' FROM p_holt),
scores AS (
  SELECT p.entity, p.category, p.model,
         avg(CASE WHEN actual <> 0 THEN abs((actual - f) / actual) END) * 100 AS mape,
         sqrt(avg(pow(actual - f, 2))) AS rmse
  FROM preds p JOIN test t ON t.entity = p.entity AND t.category = p.category AND t.step = p.step
  GROUP BY 1, 2, 3)"""

CLOSED_FORM = ("naive_drift", "linear_trend", "segmented")


def _scores(spark, sf, models=CLOSED_FORM):
    st = stages_for(spark, sf)
    return BT.backtest_scores(st.panel, st.breaks, KEYS, models=models)


@register("backtest_scores", with_panel(BT_SQL + """
SELECT entity, category, model, round(mape, 4) AS mape, round(rmse, 2) AS rmse FROM scores
WHERE model <> 'holt'""", recursive=True))
def q_backtest_scores(spark, sf):
    return _scores(spark, sf).select(*KEYS, "model", r4("mape").alias("mape"), r2("rmse").alias("rmse"))


@register("backtest_detail", with_panel(BT_SQL + """
SELECT p.entity, p.category, p.model, p.step, round(f + 1e-7, 4) AS prediction, round(actual, 2) AS actual,
       CAST(b.t_first + b.n - 6 AS INTEGER) AS train_last_t
FROM preds p JOIN test t ON t.entity = p.entity AND t.category = p.category AND t.step = p.step
JOIN btinfo b ON b.entity = p.entity AND b.category = p.category""", recursive=True))
def q_backtest_detail(spark, sf):
    """What every model predicted for the holdout, what came, and the last
    period the models had seen.  Fits on a few cents often end in a 5 at the
    fifth place, so such ties are lifted over it in engine and SQL alike."""
    st = stages_for(spark, sf)
    d = BT.backtest_detail(st.panel, st.breaks, KEYS)
    return d.select(*KEYS, "model", "step", r4(F.col("prediction") + 1e-7).alias("prediction"), r2("actual").alias("actual"), "train_last_t")


@register("backtest_holt", with_panel(BT_SQL + """
SELECT entity, category, model, round(mape, 4) AS mape, round(rmse, 2) AS rmse FROM scores
WHERE model = 'holt'""", recursive=True))
def q_backtest_holt(spark, sf):
    return _scores(spark, sf, ("holt",)).select(*KEYS, "model", r4("mape").alias("mape"), r2("rmse").alias("rmse"))


@register("segmented_vs_linear", with_panel(BT_SQL + """, wide AS (
  SELECT entity, category, max(CASE WHEN model = 'linear_trend' THEN mape END) AS linear_trend_mape,
         max(CASE WHEN model = 'segmented' THEN mape END) AS segmented_mape FROM scores GROUP BY 1, 2),
comp AS (SELECT w.* FROM wide w WHERE segmented_mape IS NOT NULL AND linear_trend_mape IS NOT NULL
         AND (entity, category) IN (SELECT (entity, category) FROM breaks WHERE breakpoint_t IS NOT NULL))
SELECT entity, category, round(linear_trend_mape, 4) AS linear_trend_mape, round(segmented_mape, 4) AS segmented_mape,
       round(linear_trend_mape - segmented_mape, 4) AS improvement, linear_trend_mape - segmented_mape > 0 AS segmented_wins,
       round(greatest(least(linear_trend_mape - segmented_mape, 50.0), -50.0), 4) AS improvement_clipped,
       abs(linear_trend_mape - segmented_mape) > 50 AS clipped
FROM comp""", recursive=True))
def q_segmented_vs_linear(spark, sf):
    st = stages_for(spark, sf)
    p, br = st.panel, st.breaks
    sc = BT.backtest_scores(p, br, KEYS, models=CLOSED_FORM)
    wide = sc.groupBy(*KEYS).agg(F.max(F.when(F.col("model") == "linear_trend", F.col("mape"))).alias("linear_trend_mape"),
                                 F.max(F.when(F.col("model") == "segmented", F.col("mape"))).alias("segmented_mape"))
    c = BT.segmented_vs_linear(wide, br, KEYS)
    return c.select(*KEYS, *[r4(x).alias(x) for x in ("linear_trend_mape", "segmented_mape", "improvement")],
                    "segmented_wins", r4("improvement_clipped").alias("improvement_clipped"), "clipped")


@register("segmented_gain", with_panel(BT_SQL + """, wide AS (
  SELECT entity, category, max(CASE WHEN model = 'linear_trend' THEN mape END) AS lm,
         max(CASE WHEN model = 'segmented' THEN mape END) AS sm FROM scores GROUP BY 1, 2),
comp AS (SELECT lm - sm AS imp FROM wide WHERE sm IS NOT NULL AND lm IS NOT NULL
         AND (entity, category) IN (SELECT (entity, category) FROM breaks WHERE breakpoint_t IS NOT NULL))
SELECT count(*) AS n_compared, count(*) FILTER (WHERE imp > 0) AS n_better,
       round(avg(CASE WHEN imp > 0 THEN imp END), 4) AS avg_gain,
       round(avg(CASE WHEN imp < 0 THEN imp END), 4) AS avg_loss FROM comp""", recursive=True))
def q_segmented_gain(spark, sf):
    st = stages_for(spark, sf)
    p, br = st.panel, st.breaks
    sc = BT.backtest_scores(p, br, KEYS, models=CLOSED_FORM)
    wide = sc.groupBy(*KEYS).agg(F.max(F.when(F.col("model") == "linear_trend", F.col("mape"))).alias("linear_trend_mape"),
                                 F.max(F.when(F.col("model") == "segmented", F.col("mape"))).alias("segmented_mape"))
    s = BT.improvement_summary(BT.segmented_vs_linear(wide, br, KEYS))
    return s.select("n_compared", "n_better", r4("avg_gain").alias("avg_gain"), r4("avg_loss").alias("avg_loss"))


SUMMARY_SQL = BT_SQL + """, summary AS (
  SELECT entity, category,
    max(CASE WHEN model = 'naive_drift' THEN mape END) AS naive_drift_mape,
    max(CASE WHEN model = 'linear_trend' THEN mape END) AS linear_trend_mape,
    max(CASE WHEN model = 'holt' THEN mape END) AS holt_mape,
    max(CASE WHEN model = 'segmented' THEN mape END) AS segmented_mape,
    arg_min(model, struct_pack(m := mape, o := CASE model WHEN 'naive_drift' THEN 1 WHEN 'linear_trend' THEN 2
                                                         WHEN 'holt' THEN 3 ELSE 4 END))
      FILTER (WHERE mape IS NOT NULL) AS best_model,
    min(mape) AS best_mape
  FROM scores GROUP BY 1, 2)"""


def _summary(spark, sf):
    st = stages_for(spark, sf)
    return st.panel, st.breaks, st.summary


@register("backtest_summary", with_panel(SUMMARY_SQL + """
SELECT entity, category, best_model, round(best_mape, 4) AS best_mape, round(naive_drift_mape, 4) AS naive_drift_mape,
       round(linear_trend_mape, 4) AS linear_trend_mape, round(holt_mape, 4) AS holt_mape,
       round(segmented_mape, 4) AS segmented_mape FROM summary""", recursive=True))
def q_backtest_summary(spark, sf):
    _, _, s = _summary(spark, sf)
    return s.select(*KEYS, "best_model", r4("best_mape").alias("best_mape"),
                    *[r4(f"{m}_mape").alias(f"{m}_mape") for m in MD.MODEL_ORDER])


@register("best_model", with_panel(SUMMARY_SQL + """
SELECT entity, category, best_model, round(best_mape, 4) AS best_mape FROM summary""", recursive=True))
def q_best_model(spark, sf):
    _, _, s = _summary(spark, sf)
    return s.select(*KEYS, "best_model", r4("best_mape").alias("best_mape"))


@register("model_wins", with_panel(SUMMARY_SQL + """
SELECT best_model, count(*) AS n FROM summary GROUP BY 1""", recursive=True))
def q_model_wins(spark, sf):
    _, _, s = _summary(spark, sf)
    return s.groupBy("best_model").agg(F.count("*").alias("n"))


@register("mape_summary", with_panel(SUMMARY_SQL + """
SELECT count(*) AS n_series, round(median(best_mape), 4) AS median_mape, round(avg(best_mape), 4) AS mean_mape
FROM summary""", recursive=True))
def q_mape_summary(spark, sf):
    _, _, s = _summary(spark, sf)
    mid = quantiles(s, ["best_mape"], [0.5]).select(r4(F.col("_q_best_mape")[0]).alias("median_mape"))
    mean = s.agg(F.count("*").alias("n_series"), r4(F.avg("best_mape")).alias("mean_mape"))
    return mean.crossJoin(F.broadcast(mid)).select("n_series", "median_mape", "mean_mape")     # one row each


# ------------------------------------------------------------ final forecast
def floor_sql(src: str, lastv: str) -> str:
    """Floor chain as a recursive CTE over the forecast steps: ``src``
    (entity, category, step, f, lo, hi), ``lastv``(entity, category, t_last,
    last_value) -> ``nfc``(entity, category, t, forecast, lower_80, upper_80)."""
    return f""",
fl(entity, category, step, prev, f, lo, hi) AS (
  SELECT entity, category, 0, last_value, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  FROM {lastv}
  UNION ALL
  SELECT p.entity, p.category, p.step,
    CASE WHEN p.f < fl.prev * 0.7 THEN fl.prev * 0.7 ELSE p.f END,
    CASE WHEN p.f < fl.prev * 0.7 THEN fl.prev * 0.7 ELSE p.f END,
    CASE WHEN p.f < fl.prev * 0.7 THEN greatest(p.lo, fl.prev * 0.7 * 0.9) ELSE p.lo END,
    CASE WHEN p.f < fl.prev * 0.7 THEN greatest(p.hi, fl.prev * 0.7 * 1.1) ELSE p.hi END
  FROM fl JOIN {src} p ON p.entity = fl.entity AND p.category = fl.category AND p.step = fl.step + 1),
nfc AS (SELECT fl.entity, fl.category, CAST(l.t_last + fl.step AS INTEGER) AS t, greatest(f, 0.0) AS forecast,
               greatest(lo, 0.0) AS lower_80, greatest(hi, 0.0) AS upper_80
        FROM fl JOIN {lastv} l ON l.entity = fl.entity AND l.category = fl.category WHERE fl.step > 0)"""


FINAL_SQL = SUMMARY_SQL + """, full8 AS (SELECT entity, category, i, value FROM tri WHERE n >= 8),
finfo AS (SELECT t.entity, t.category, max(t.t) AS t_last, arg_max(t.value, t.t) AS last_value, min(t.t_first) AS t_first
          FROM tri t WHERE t.n >= 8 GROUP BY 1, 2),
fwin AS (SELECT f.entity, f.category, f.t_last, f.last_value, coalesce(s.best_model, 'naive_drift') AS model_used,
                b.breakpoint_t - f.t_first AS bp_idx
         FROM finfo f LEFT JOIN summary s ON s.entity = f.entity AND s.category = f.category
         LEFT JOIN breaks b ON b.entity = f.entity AND b.category = f.category),
fbp AS (SELECT entity, category, bp_idx FROM fwin),
fh_holt AS (SELECT h.* FROM full8 h JOIN fwin w ON w.entity = h.entity AND w.category = h.category
            WHERE w.model_used = 'holt')""" + naive_sql("ff_naive", "full8") + linear_sql("ff_lin", "full8") \
    + segmented_sql("ff_seg", "full8", "fbp") + holt_sql("ff_holt", "fh_holt") + """,
fsel AS (
  SELECT p.entity, p.category, p.step, p.f, p.lo, p.hi FROM ff_naive p JOIN fwin w USING (entity, category)
  WHERE w.model_used = 'naive_drift'
  UNION ALL SELECT p.entity, p.category, p.step, p.f, p.lo, p.hi FROM ff_lin p JOIN fwin w USING (entity, category)
  WHERE w.model_used = 'linear_trend'
  UNION ALL SELECT p.entity, p.category, p.step, p.f, p.lo, p.hi FROM ff_seg p JOIN fwin w USING (entity, category)
  WHERE w.model_used = 'segmented'
  UNION ALL SELECT p.entity, p.category, p.step, p.f, p.lo, p.hi FROM ff_holt p JOIN fwin w USING (entity, category)
  WHERE w.model_used = 'holt')""" + floor_sql("fsel", "fwin") + """,
final AS (SELECT n.*, w.model_used, w.bp_idx IS NOT NULL AS had_breakpoint
          FROM nfc n JOIN fwin w ON w.entity = n.entity AND w.category = n.category)"""


def final_forecasts(spark, sf):
    return stages_for(spark, sf).forecasts


def _fc_final_out(df):
    return df.select(*KEYS, "t", r2("forecast").alias("forecast"), r2("lower_80").alias("lower_80"),
                     r2("upper_80").alias("upper_80"), "model_used", "had_breakpoint")


@register("forecast_final", with_panel(FINAL_SQL + """
SELECT entity, category, t, round(forecast, 2) AS forecast, round(lower_80, 2) AS lower_80,
       round(upper_80, 2) AS upper_80, model_used, had_breakpoint FROM final""", recursive=True))
def q_forecast_final(spark, sf):
    return _fc_final_out(final_forecasts(spark, sf))


FLOOR_SQL = FULL + naive_sql("nf", "full8") + """, lastv AS (
  SELECT entity, category, max(t) AS t_last, arg_max(value, t) AS last_value FROM tri WHERE n >= 8 GROUP BY 1, 2),
fl(entity, category, step, prev, f, lo, hi) AS (
  SELECT entity, category, 0, last_value, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM lastv
  UNION ALL
  SELECT p.entity, p.category, p.step,
    CASE WHEN p.f < fl.prev * 0.7 THEN fl.prev * 0.7 ELSE p.f END,
    CASE WHEN p.f < fl.prev * 0.7 THEN fl.prev * 0.7 ELSE p.f END,
    CASE WHEN p.f < fl.prev * 0.7 THEN greatest(p.lo, fl.prev * 0.7 * 0.9) ELSE p.lo END,
    CASE WHEN p.f < fl.prev * 0.7 THEN greatest(p.hi, fl.prev * 0.7 * 1.1) ELSE p.hi END
  FROM fl JOIN nf p ON p.entity = fl.entity AND p.category = fl.category AND p.step = fl.step + 1),
nfc AS (SELECT fl.entity, fl.category, CAST(l.t_last + fl.step AS INTEGER) AS t, greatest(f, 0.0) AS forecast,
               greatest(lo, 0.0) AS lower_80, greatest(hi, 0.0) AS upper_80
        FROM fl JOIN lastv l ON l.entity = fl.entity AND l.category = fl.category WHERE fl.step > 0)"""


def naive_final(spark, sf):
    """Final forecast with the naive model for every series (floor applied)."""
    p = stages_for(spark, sf).panel
    empty = p.select(*KEYS).limit(0).withColumn("best_model", F.lit(None).cast("string"))
    nob = p.select(*KEYS).limit(0).withColumn("breakpoint_t", F.lit(None).cast("int"))
    return FC.forecast_all(p, nob, empty, KEYS, models=("naive_drift",))


@register("forecast_floor", with_panel(FLOOR_SQL + """
SELECT entity, category, t, round(forecast, 2) AS forecast, round(lower_80, 2) AS lower_80,
       round(upper_80, 2) AS upper_80 FROM nfc""", recursive=True))
def q_forecast_floor(spark, sf):
    f = naive_final(spark, sf)
    return f.select(*KEYS, "t", r2("forecast").alias("forecast"), r2("lower_80").alias("lower_80"),
                    r2("upper_80").alias("upper_80"))


#: The final forecasts and the last actual values, for the projections.
PROJECTED_SQL = FINAL_SQL + """, lastv AS (SELECT * FROM finfo)"""


@register("forecast_extent", with_panel(PROJECTED_SQL + """
SELECT count(DISTINCT (entity, category)) AS n_series, min(t) AS t_min, max(t) AS t_max, count(*) AS n_rows
FROM nfc""", recursive=True))
def q_forecast_extent(spark, sf):
    f = final_forecasts(spark, sf)
    return f.agg(F.countDistinct(*KEYS).alias("n_series"), F.min("t").alias("t_min"), F.max("t").alias("t_max"),
                 F.count("*").alias("n_rows"))


@register("growth_top", with_panel(PROJECTED_SQL + """, fin AS (
  SELECT f.entity, f.category, round(f.forecast / 1e6, 1) AS forecast_m, round(l.last_value / 1e6, 1) AS last_m,
         (f.forecast - l.last_value) / nullif(l.last_value, 0) * 100 AS g
  FROM nfc f JOIN lastv l ON l.entity = f.entity AND l.category = f.category
  WHERE f.t = (SELECT max(t) FROM nfc))
SELECT entity, category, forecast_m, last_m, round(g, 4) AS growth_pct FROM fin
WHERE g IS NOT NULL ORDER BY g DESC, entity, category LIMIT 10""", recursive=True))
def q_growth_top(spark, sf):
    """Top 10 series by growth from the last actual to the last
    forecast period (a top-k report: the limit is the feature)."""
    p = stages_for(spark, sf).panel
    f = final_forecasts(spark, sf)
    last = BT.indexed(p, KEYS).groupBy(*KEYS).agg(F.max_by("value", "t").alias("last_value"))
    tmax = f.agg(F.max("t").alias("t"))
    fin = f.join(F.broadcast(tmax), "t").join(last, KEYS)
    g = (F.col("forecast") - F.col("last_value")) / F.nullif(F.col("last_value"), F.lit(0)) * 100
    fin = fin.select(*KEYS, rnd(F.col("forecast") / 1e6, 1).alias("forecast_m"),
                     rnd(F.col("last_value") / 1e6, 1).alias("last_m"), g.alias("g")).filter(F.col("g").isNotNull())
    return fin.orderBy(F.desc("g"), *KEYS).limit(10).select(*KEYS, "forecast_m", "last_m", r4("g").alias("growth_pct"))


@register("regional_forecast", with_panel(PROJECTED_SQL + """, reg AS (SELECT DISTINCT entity, region FROM panel),
la AS (SELECT g.region, CAST(sum(CAST(p.value AS DECIMAL(20,2))) AS DOUBLE) AS last_actual
       FROM panel p JOIN reg g ON g.entity = p.entity WHERE p.t = (SELECT max(t) FROM panel) GROUP BY 1),
lf AS (SELECT g.region, sum(f.forecast) AS last_forecast FROM nfc f JOIN reg g ON g.entity = f.entity
       WHERE f.t = (SELECT max(t) FROM nfc) GROUP BY 1),
r AS (SELECT la.region, last_actual, last_forecast FROM la JOIN lf ON la.region = lf.region)
SELECT region, round(last_actual, 2) AS last_actual, round(last_forecast, 2) AS last_forecast,
       round((last_forecast - last_actual) / nullif(last_actual, 0) * 100, 4) AS growth_pct FROM r
UNION ALL
SELECT 'TOTAL', round(sum(last_actual), 2), round(sum(last_forecast), 2),
       round((sum(last_forecast) - sum(last_actual)) / nullif(sum(last_actual), 0) * 100, 4) FROM r""",
                                          recursive=True))
def q_regional_forecast(spark, sf):
    """Region and global growth from the last actual period to the
    last forecast period."""
    from ..functions.exprs import dsum
    p = stages_for(spark, sf).panel
    f = final_forecasts(spark, sf)
    reg = p.select("entity", "region").distinct()
    tp = p.agg(F.max("t").alias("t"))
    la = p.join(F.broadcast(tp), "t").groupBy("region").agg(dsum("value").alias("last_actual"))
    tf = f.agg(F.max("t").alias("t"))
    lf = f.join(F.broadcast(tf), "t").join(reg, "entity").groupBy("region").agg(F.sum("forecast").alias("last_forecast"))
    r = la.join(lf, "region")
    tot = r.agg(F.lit("TOTAL").alias("region"), F.sum("last_actual").alias("last_actual"),
                F.sum("last_forecast").alias("last_forecast"))
    u = r.unionByName(tot)
    g = (F.col("last_forecast") - F.col("last_actual")) / F.nullif(F.col("last_actual"), F.lit(0)) * 100
    return u.select("region", r2("last_actual").alias("last_actual"), r2("last_forecast").alias("last_forecast"),
                    r4(g).alias("growth_pct"))


@register("forecast_ribbon", with_panel(PROJECTED_SQL + """, top AS (
  SELECT entity, category FROM (SELECT entity, category, avg(value) AS mv FROM panel GROUP BY 1, 2)
  ORDER BY mv DESC, entity, category LIMIT 10),
hist AS (SELECT p.entity, p.category, p.t, p.value, p.value AS lower_80, p.value AS upper_80, 'history' AS kind
         FROM panel p JOIN top USING (entity, category)),
anchor AS (SELECT l.entity, l.category, CAST(l.t_last AS INTEGER) AS t, l.last_value AS value,
                  l.last_value AS lower_80, l.last_value AS upper_80, 'anchor' AS kind
           FROM lastv l JOIN top USING (entity, category)),
fut AS (SELECT f.entity, f.category, f.t, f.forecast, f.lower_80, f.upper_80, 'forecast' AS kind
        FROM nfc f JOIN top USING (entity, category)),
u AS (SELECT * FROM hist UNION ALL SELECT * FROM anchor UNION ALL SELECT * FROM fut)
SELECT entity, category, t, kind, round(value, 2) AS value, round(lower_80, 2) AS lower_80,
       round(upper_80, 2) AS upper_80 FROM u""", recursive=True))
def q_forecast_ribbon(spark, sf):
    """History, the last actual repeated as the first forecast point, and
    the forecast, for the ten largest series by mean (top-k report)."""
    p = stages_for(spark, sf).panel
    f = final_forecasts(spark, sf)
    top = M.wide_metrics(p).orderBy(F.desc("mean_value"), *KEYS).limit(10).select(*KEYS)
    top = F.broadcast(top)                                          # 10 rows
    hist = p.join(top, KEYS).select(*KEYS, "t", "value", F.col("value").alias("lower_80"),
                                    F.col("value").alias("upper_80"), F.lit("history").alias("kind"))
    last = BT.indexed(p, KEYS).filter(F.col("n") >= 8).groupBy(*KEYS).agg(
        F.max("t").alias("t"), F.max_by("value", "t").alias("value"))
    anchor = last.join(top, KEYS).select(*KEYS, F.col("t").cast("int").alias("t"), "value",
                                         F.col("value").alias("lower_80"), F.col("value").alias("upper_80"),
                                         F.lit("anchor").alias("kind"))
    fut = f.join(top, KEYS).select(*KEYS, "t", F.col("forecast").alias("value"), "lower_80", "upper_80",
                                   F.lit("forecast").alias("kind"))
    u = hist.unionByName(anchor).unionByName(fut)
    return u.select(*KEYS, "t", "kind", r2("value").alias("value"), r2("lower_80").alias("lower_80"),
                    r2("upper_80").alias("upper_80"))


@register("entity_forecast", with_panel(PROJECTED_SQL + """, la AS (
  SELECT entity, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS last_actual FROM panel
  WHERE t = (SELECT max(t) FROM panel) GROUP BY 1),
ef AS (SELECT entity, t, sum(forecast) AS fc, sum(lower_80) AS lo, sum(upper_80) AS hi,
              string_agg(DISTINCT model_used, ',' ORDER BY model_used) AS models, bool_or(had_breakpoint) AS had_breakpoint
       FROM final GROUP BY 1, 2)
SELECT ef.entity, ef.t, models, had_breakpoint, round(fc / 1e6, 1) AS forecast_m, round(lo / 1e6, 1) AS lower_m, round(hi / 1e6, 1) AS upper_m,
       round((fc - last_actual) / nullif(last_actual, 0) * 100, 4) AS growth_vs_last_pct
FROM ef JOIN la ON la.entity = ef.entity""", recursive=True))
def q_entity_forecast(spark, sf):
    """Per entity and forecast period: totals over categories with
    bands (millions, 1 decimal) and growth vs the last actual period."""
    from ..functions.exprs import dsum
    p = stages_for(spark, sf).panel
    f = final_forecasts(spark, sf)
    tp = p.agg(F.max("t").alias("t"))
    la = p.join(F.broadcast(tp), "t").groupBy("entity").agg(dsum("value").alias("last_actual"))
    ef = f.groupBy("entity", "t").agg(F.sum("forecast").alias("fc"), F.sum("lower_80").alias("lo"),
                                      F.sum("upper_80").alias("hi"),
                                      F.array_join(F.sort_array(F.collect_set("model_used")), ",").alias("models"),
                                      F.max("had_breakpoint").alias("had_breakpoint"))
    j = ef.join(la, "entity")
    g = (F.col("fc") - F.col("last_actual")) / F.nullif(F.col("last_actual"), F.lit(0)) * 100
    return j.select("entity", "t", "models", "had_breakpoint", rnd(F.col("fc") / 1e6, 1).alias("forecast_m"),
                    rnd(F.col("lo") / 1e6, 1).alias("lower_m"), rnd(F.col("hi") / 1e6, 1).alias("upper_m"),
                    r4(g).alias("growth_vs_last_pct"))


# ------------------------------------------------------------ Panel B (users x days)
USERS = ", panel AS (SELECT * FROM panel_b)"


@register("users_breaks", with_panel(USERS + BREAKS + """
SELECT entity, category, breakpoint_t, round(pre_slope, 4) AS pre_slope, round(post_slope, 4) AS post_slope,
       round(slope_change_pct, 4) AS slope_change_pct, significance, n_observations FROM breaks""",
                                     b=True, recursive=True))
def q_users_breaks(spark, sf):
    """T7 on Panel B: one row per user with any activity."""
    from .stages import user_stages_for
    b = user_stages_for(spark, sf).breaks
    return b.select(*KEYS, "breakpoint_t", *[r4(c).alias(c) for c in ("pre_slope", "post_slope",
                                                                          "slope_change_pct")],
                    "significance", "n_observations")


@register("users_backtest", with_panel(USERS + SUMMARY_SQL + """
SELECT entity, category, best_model, round(best_mape, 4) AS best_mape, round(naive_drift_mape, 4) AS naive_drift_mape,
       round(linear_trend_mape, 4) AS linear_trend_mape, round(holt_mape, 4) AS holt_mape,
       round(segmented_mape, 4) AS segmented_mape FROM summary""", b=True, recursive=True))
def q_users_backtest(spark, sf):
    """T17 on Panel B."""
    from .stages import user_stages_for
    s = user_stages_for(spark, sf).summary
    return s.select(*KEYS, "best_model", r4("best_mape").alias("best_mape"),
                    *[r4(f"{m}_mape").alias(f"{m}_mape") for m in MD.MODEL_ORDER])


@register("users_forecast", with_panel(USERS + FINAL_SQL + """
SELECT entity, category, t, round(forecast, 2) AS forecast, round(lower_80, 2) AS lower_80,
       round(upper_80, 2) AS upper_80, model_used, had_breakpoint FROM final""", b=True, recursive=True))
def q_users_forecast(spark, sf):
    """T18/T19 on Panel B."""
    from .stages import user_stages_for
    return _fc_final_out(user_stages_for(spark, sf).forecasts)
