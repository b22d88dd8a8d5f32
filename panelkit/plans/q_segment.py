"""Queries of the segmentation and scoring stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r2, r4, r6, rnd
from ..operators import cluster as CL
from ..operators import features as FT
from ..operators import lookups as LK
from ..operators import metrics as M
from ..operators import rules as RU
from ..operators import score as SC
from ..sources.tables import read_table
from .catalog import register
from .panels import panel_a
from .q_prepare import HIST_SQL
from .q_series import BREAKS, FINAL_SQL
from .segments import REGION_SQL, register_both
from .sqlparts import with_panel
from .stages import stages_for

IPS_COLS = ["size_log", "growth_forecast", "acceleration", "predictability"]
FEATS = ["mean", "cv", "size_log", "growth_historical", "growth_forecast", "predictability",
         "had_breakpoint", "share_global_pct", "acceleration"]


def _feat_out(df):
    return df.select("entity", "region", *[r6(c).alias(c) if c != "had_breakpoint" else F.col(c)
                                           for c in FEATS])


FEAT_SQL = FINAL_SQL + HIST_SQL + """, es AS (
  SELECT entity, avg(value) AS mean, stddev_samp(value) AS std FROM ep GROUP BY 1),
lastt AS (SELECT max(t) AS t_last FROM panel),
act AS (SELECT entity, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS actual_last
        FROM panel, lastt WHERE t = t_last GROUP BY 1),
fce AS (SELECT entity, t, sum(forecast) AS fh FROM final GROUP BY 1, 2),
gf AS (SELECT a.entity, (pow(nullif(f.fh, 0) / nullif(a.actual_last, 0), 1.0 / 5) - 1) * 100 AS growth_forecast
       FROM act a JOIN fce f ON f.entity = a.entity AND f.t = (SELECT t_last FROM lastt) + 5),
wmean AS (SELECT entity, category, avg(value) AS mean_value FROM panel GROUP BY 1, 2),
pg AS (SELECT s.entity, coalesce(sum(s.best_mape * w.mean_value), 0.0) AS num, sum(w.mean_value) AS den
       FROM summary s LEFT JOIN wmean w ON w.entity = s.entity AND w.category = s.category GROUP BY 1),
pr AS (SELECT entity, CASE WHEN den > 0 THEN least(greatest(100 - num / den, 0.0), 100.0) END AS predictability
       FROM pg),
hb AS (SELECT entity, CAST(max(CASE WHEN breakpoint_t IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS had_breakpoint
       FROM breaks GROUP BY 1),
shr AS (SELECT entity, actual_last / nullif(sum(actual_last) OVER (), 0) * 100 AS share_global_pct FROM act),
reg AS (SELECT DISTINCT entity, region FROM panel),
feat AS (
  SELECT es.entity, reg.region, es.mean, es.std / nullif(es.mean, 0) AS cv, log10(greatest(es.mean, 1)) AS size_log,
         hist.growth_historical, gf.growth_forecast, pr.predictability, hb.had_breakpoint, shr.share_global_pct,
         gf.growth_forecast - hist.growth_historical AS acceleration
  FROM es LEFT JOIN hist ON hist.entity = es.entity LEFT JOIN gf ON gf.entity = es.entity
  LEFT JOIN pr ON pr.entity = es.entity LEFT JOIN hb ON hb.entity = es.entity
  LEFT JOIN shr ON shr.entity = es.entity LEFT JOIN reg ON reg.entity = es.entity)"""


@register("entity_features", with_panel(FEAT_SQL + """
SELECT entity, region, """ + ", ".join(f"round({c}, 6) AS {c}" if c != "had_breakpoint" else c for c in FEATS)
                                        + " FROM feat", recursive=True))
def q_entity_features(spark, sf):
    return _feat_out(stages_for(spark, sf).features)


@register("had_break", with_panel(BREAKS + """
SELECT entity, CAST(max(CASE WHEN breakpoint_t IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS had_breakpoint
FROM breaks GROUP BY 1""", recursive=True))
def q_had_break(spark, sf):
    return FT.had_breakpoint(stages_for(spark, sf).breaks)


@register("share_now", with_panel(""", lp AS (
  SELECT entity, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS v FROM panel
  WHERE t = (SELECT max(t) FROM panel) GROUP BY 1)
SELECT entity, round(v / nullif(sum(v) OVER (), 0) * 100, 6) AS share_global_pct FROM lp"""))
def q_share_now(spark, sf):
    return FT.share_now(panel_a(spark, sf)).select("entity", r6("share_global_pct").alias("share_global_pct"))


@register("predictability", with_panel(FEAT_SQL + """
SELECT entity, round(predictability, 6) AS predictability FROM pr""", recursive=True))
def q_predictability(spark, sf):
    st = stages_for(spark, sf)
    return FT.predictability(st.panel, st.summary).select("entity", r6("predictability").alias("predictability"))


@register("growth_forecast", with_panel(FEAT_SQL + """
SELECT entity, round(growth_forecast, 6) AS growth_forecast FROM gf""", recursive=True))
def q_growth_forecast(spark, sf):
    st = stages_for(spark, sf)
    return FT.growth_forecast(st.panel, st.forecasts).select("entity", r6("growth_forecast").alias("growth_forecast"))


# Winsorise / robust-scale exercised on the entity statistics (holt-free).
WCOLS = ["mean", "cv", "size_log"]
ESTATS = """, ep AS (
  SELECT entity, t, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS value FROM panel GROUP BY 1, 2),
es AS (SELECT entity, avg(value) AS mean, stddev_samp(value) / nullif(avg(value), 0) AS cv,
              log10(greatest(avg(value), 1)) AS size_log FROM ep GROUP BY 1)"""


def _estats(spark, sf):
    return M.entity_stats(panel_a(spark, sf)).select("entity", *WCOLS)


@register("winsorize", with_panel(ESTATS + """, q AS (
  SELECT """ + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in WCOLS)
          + """ FROM es)
SELECT entity, """ + ", ".join(f"round(least(greatest({c}, lo_{c}), hi_{c}), 6) AS {c}" for c in WCOLS)
          + " FROM es, q"))
def q_winsorize(spark, sf):
    w = FT.winsorize(_estats(spark, sf), WCOLS)
    return w.select("entity", *[r6(c).alias(c) for c in WCOLS])


@register("robust_scale", with_panel(ESTATS + """, q AS (
  SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, "
                         f"CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
                         f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in WCOLS)
          + """ FROM es)
SELECT entity, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in WCOLS) + " FROM es, q"))
def q_robust_scale(spark, sf):
    s, _ = FT.robust_scale(_estats(spark, sf), WCOLS)
    return s.select("entity", *[r6(f"z_{c}").alias(f"z_{c}") for c in WCOLS])


# ---------------------------------------------------------------- clustering
@register("kmeans_segments")
def q_kmeans_segments(spark, sf):
    s = stages_for(spark, sf).segments
    return s.select("entity", "cluster", "cluster_name")


@register("pca_2d")
def q_pca_2d(spark, sf):
    s = stages_for(spark, sf).segments
    return s.select("entity", r6("pca_x").alias("pca_x"), r6("pca_y").alias("pca_y"))


@register("segment_centroids")
def q_segment_centroids(spark, sf):
    c = stages_for(spark, sf).centroids
    return c.select("cluster", "cluster_name", "n_entities", *[r6(x).alias(x) for x in FT.CLUSTER_FEATURES])


@register("clustering_meta")
def q_clustering_meta(spark, sf):
    """S4 content: best k, silhouette per k and explained variance as rows."""
    st = stages_for(spark, sf)
    st.segments
    m = st.meta
    rows = [("best_k", float(m["best_k"])), ("steps", float(m["steps"])), ("converged", float(m["converged"]))] + [(f"silhouette_k{k}", float(v)) for k, v in m["silhouette"].items()] \
        + [(f"explained_variance_{i + 1}", float(v)) for i, v in enumerate(m["explained_variance"])]
    return spark.createDataFrame(rows, "metric string, value double")


EMB_LONG = """emb AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos
            FROM embeddings)"""


@register("silhouette", """WITH """ + EMB_LONG + """,
nrm AS (SELECT vec_id, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS q FROM emb GROUP BY 1),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(pow(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE), 2)) AS d2
          FROM emb a JOIN emb b ON a.pos = b.pos AND a.vec_id <> b.vec_id GROUP BY 1, 2),
lab AS (SELECT DISTINCT vec_id, label FROM embeddings),
md AS (SELECT p.i, lj.label AS cl, li.label AS own, avg(d2) AS md
       FROM pairs p JOIN lab li ON li.vec_id = p.i JOIN lab lj ON lj.vec_id = p.j GROUP BY 1, 2, 3),
sz AS (SELECT label, count(*) AS n FROM lab GROUP BY 1),
per AS (SELECT l.vec_id, max(CASE WHEN md.cl = md.own THEN md.md END) AS a,
               min(CASE WHEN md.cl <> md.own THEN md.md END) AS b, max(sz.n) AS n_own
        FROM lab l LEFT JOIN md ON md.i = l.vec_id JOIN sz ON sz.label = l.label GROUP BY 1),
s AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM per)
SELECT round(avg(s), 6) AS silhouette, count(*) AS n_points FROM s""")
def q_silhouette(spark, sf):
    """M6: squared-Euclidean silhouette of the embeddings under their given
    labels (O(N k d) from cluster sums)."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    lab = e.select("vec_id", F.col("label").alias("cluster"))
    per = CL.silhouette_sq(e, "vec_id", "embedding", lab)
    return per.agg(r6(F.avg("s")).alias("silhouette"), F.count("*").alias("n_points"))


CENT_SQL = """WITH """ + EMB_LONG + """,
cent AS (SELECT label AS cluster, pos, avg(CAST(x AS DOUBLE)) AS cx FROM emb GROUP BY 1, 2)"""


@register("assign_nearest", CENT_SQL + """,
d AS (SELECT e.vec_id, c.cluster, sum(pow(CAST(e.x AS DOUBLE) - c.cx, 2)) AS d2
      FROM emb e JOIN cent c ON c.pos = e.pos GROUP BY 1, 2)
SELECT vec_id, CAST(arg_min(cluster, (d2, cluster)) AS INTEGER) AS cluster FROM d GROUP BY 1""")
def q_assign_nearest(spark, sf):
    """Nearest of the label centroids for every vector."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    px = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    cent = px.groupBy(F.col("label").alias("cluster"), "pos").agg(F.avg(F.col("x").cast("double")).alias("cx"))
    a = CL.nearest_centroid(e, "vec_id", "embedding", cent)
    return a.select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@register("embedding_covariance", """WITH """ + EMB_LONG + """
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j,
       round(covar_samp(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)), 8) AS cov
FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY 1, 2""")
def q_embedding_covariance(spark, sf):
    """M8's moments: covariance of every two components of the vectors."""
    c = CL.covariance(read_table(spark, sf, "embeddings", "embedding"), "embedding")
    return c.select("i", "j", rnd("cov", 8).alias("cov"))


@register("segment_profiles", CENT_SQL + """,
ext AS (SELECT pos, min(cx) AS lo, max(cx) AS hi FROM cent GROUP BY 1)
SELECT cluster, CAST(c.pos AS INTEGER) AS pos,
       round(CASE WHEN hi <> lo THEN (cx - lo) / (hi - lo) * 100 END, 6) AS norm
FROM cent c JOIN ext e ON e.pos = c.pos""")
def q_segment_profiles(spark, sf):
    """M11 on fixed centroids: label centroids of all embedding dimensions
    scaled 0..100 across clusters, one row per cluster and dimension."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    cols = [f"f{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    c = e.groupBy(F.col("label").alias("cluster")).agg(
        *[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f) for i, f in enumerate(cols)])
    p = CL.minmax_profile(c, cols)
    return p.select("cluster", F.posexplode(F.array(*[r6(f"{f}_norm") for f in cols])).alias("pos", "norm"))


@register("name_segments", with_panel(""", span AS (SELECT max(t) AS t_last FROM panel),
ends AS (SELECT entity, category, region, t_last, CAST(floor((t_last + 1) / 2) AS INTEGER) AS h,
           max(CASE WHEN t = 0 THEN value END) AS v0,
           max(CASE WHEN t = CAST(floor((t_last + 1) / 2) AS INTEGER) THEN value END) AS vm,
           max(CASE WHEN t = t_last THEN value END) AS v1
         FROM panel, span GROUP BY 1, 2, 3, 4),
cg AS (SELECT region, (pow(nullif(vm, 0) / nullif(v0, 0), 1.0 / h) - 1) * 100 AS c1,
              (pow(nullif(v1, 0) / nullif(vm, 0), 1.0 / (t_last - h)) - 1) * 100 AS c2 FROM ends),
cent AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS cluster,
                avg(c2) AS growth_forecast, avg(c2 - c1) AS acceleration FROM cg GROUP BY 1),
b AS (SELECT *, CASE WHEN growth_forecast < -8 THEN 'Crisis Económica' WHEN growth_forecast < 0 THEN 'Estancamiento'
                     WHEN acceleration > 1.5 THEN 'Aceleración Sostenida' WHEN growth_forecast > 2 THEN 'Crecimiento Maduro'
                     WHEN growth_forecast > 0.5 THEN 'Maduros Estables' ELSE 'Estables Predecibles' END AS base_name
      FROM cent),
r AS (SELECT *, count(*) OVER (PARTITION BY base_name) AS dup,
             row_number() OVER (PARTITION BY base_name ORDER BY growth_forecast, cluster) - 1 AS rk FROM b)
SELECT region, CAST(cluster AS INTEGER) AS cluster, round(growth_forecast, 4) AS growth_forecast,
       round(acceleration, 4) AS acceleration, base_name,
       CASE WHEN dup > 1 THEN base_name || CASE WHEN base_name = 'Estancamiento' THEN CASE WHEN rk = 0 THEN ' Severo' ELSE ' Leve' END
                                              WHEN base_name = 'Crecimiento Maduro' THEN CASE WHEN rk = 0 THEN ' Lento' ELSE ' Rápido' END
                                              ELSE ' (variante ' || CAST(rk + 1 AS VARCHAR) || ')' END
            ELSE base_name END AS cluster_name
FROM r"""))
def q_name_segments(spark, sf):
    """C5/C6 on fixed centroids: one centroid per region with growth = mean
    second-half CAGR and acceleration = mean (second - first half CAGR) of
    its series."""
    from pyspark.sql import Window
    p = panel_a(spark, sf)
    cg = M.cagr_halves(p).join(p.select("entity", "category", "region").distinct(), ["entity", "category"])
    cent = cg.groupBy("region").agg(F.avg("cagr_second_half").alias("growth_forecast"),
                                    F.avg(F.col("cagr_second_half") - F.col("cagr_first_half")).alias("acceleration"))
    cent = cent.withColumn("cluster", (F.row_number().over(Window.orderBy("region")) - 1).cast("int"))
    n = RU.name_segments(cent)
    return n.select("region", "cluster", r4("growth_forecast").alias("growth_forecast"),
                    r4("acceleration").alias("acceleration"), "base_name", "cluster_name")


def _d(x):
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def norm_sql(src: str, name: str) -> str:
    """M12 normalisation of ``src`` (with the four index columns) -> ``name``."""
    parts = []
    for c in IPS_COLS:
        if c == "predictability":
            parts.append(f"{c} AS {c}_n0")
        else:
            parts.append(f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 "
                         f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 END AS {c}_n0")
    fill = ", ".join(f"coalesce({c}_n0, median({c}_n0) OVER ()) AS {c}_norm" for c in IPS_COLS)
    return f""", {name}_0 AS (SELECT *, {", ".join(parts)} FROM {src}),
{name} AS (SELECT *, {fill} FROM {name}_0)"""


IPS_SQL = FEAT_SQL + """, base AS (SELECT * FROM feat WHERE growth_forecast IS NOT NULL AND acceleration IS NOT NULL
                                   AND cv IS NOT NULL AND predictability IS NOT NULL)""" \
    + norm_sql("base", "nb") + """, scored AS (SELECT *, """ \
    + " + ".join(f"{c}_norm * {_d(w)}" for c, w in SC.IPS_WEIGHTS.items()) + " AS ips, " \
    + ", ".join(f"{c}_norm * {_d(w)} AS {c}_contrib" for c, w in SC.IPS_WEIGHTS.items()) + """ FROM nb),
strat AS (SELECT *, CASE WHEN ips > 60 AND coalesce(predictability > 60, false) THEN '""" + RU.STRATEGIES[0] + """'
  WHEN ips > 60 AND coalesce(predictability <= 60, false) THEN '""" + RU.STRATEGIES[1] + """'
  WHEN ips > 40 AND coalesce(predictability > 60, false) THEN '""" + RU.STRATEGIES[2] + """'
  WHEN ips > 40 THEN '""" + RU.STRATEGIES[3] + """'
  WHEN coalesce(predictability > 70, false) THEN '""" + RU.STRATEGIES[4] + """'
  ELSE '""" + RU.STRATEGIES[5] + """' END AS strategy FROM scored)"""

SENS_SQL = (FEAT_SQL + norm_sql("feat", "nf") + """,
nlong AS (""" + " UNION ALL ".join(f"SELECT entity, '{c}' AS comp, {c}_norm AS v FROM nf" for c in IPS_COLS) + """),
wbase(comp, w) AS (VALUES ('size_log', 0.3::DOUBLE), ('growth_forecast', 0.3::DOUBLE), ('acceleration', 0.2::DOUBLE),
                          ('predictability', 0.2::DOUBLE)),
wdelta(delta) AS (VALUES ((-0.1)::DOUBLE), ((-0.05)::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)),
wall AS (SELECT c.comp AS component, d.delta, o.comp, CASE WHEN o.comp = c.comp THEN o.w + d.delta ELSE o.w - d.delta / 3 END AS weight,
                c.w + d.delta AS weight_changed_to FROM wbase c, wdelta d, wbase o),
grid AS (SELECT dense_rank() OVER (ORDER BY component, delta) AS scenario, * FROM wall
         WHERE (component, delta) NOT IN (SELECT (component, delta) FROM wall WHERE weight < 0)
         UNION ALL SELECT 0, 'base', 0.0::DOUBLE, comp, w, 0.0::DOUBLE FROM wbase),
sips AS (SELECT g.scenario, n.entity, sum(n.v * g.weight) AS ips FROM nlong n JOIN grid g ON g.comp = n.comp
         GROUP BY 1, 2),
srk AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY ips DESC)
                    + (count(*) OVER (PARTITION BY scenario, ips) - 1) / 2.0 AS rk,
               row_number() OVER (PARTITION BY scenario ORDER BY ips DESC, entity) AS pos FROM sips),
sres AS (SELECT p.scenario, corr(p.rk, b.rk) AS spearman_rho,
                CAST(count(*) FILTER (WHERE p.pos <= 10 AND b.pos <= 10) AS INTEGER) AS top10_overlap
         FROM srk p JOIN srk b ON b.entity = p.entity AND b.scenario = 0 WHERE p.scenario > 0 GROUP BY 1),
sens AS (SELECT DISTINCT r.*, g.component, g.delta, g.weight_changed_to FROM sres r JOIN grid g USING (scenario))""")


# ---------------------------------------------------------------- index


@register("pressure_index", with_panel(IPS_SQL + """
SELECT entity, round(ips, 6) AS ips, """ + ", ".join(f"round({c}_norm, 6) AS {c}_norm" for c in IPS_COLS) + ", "
                                       + ", ".join(f"round({c}_contrib, 6) AS {c}_contrib" for c in IPS_COLS)
                                       + " FROM scored", recursive=True))
def q_pressure_index(spark, sf):
    s = stages_for(spark, sf).scored
    return s.select("entity", r6("ips").alias("ips"), *[r6(f"{c}_norm").alias(f"{c}_norm") for c in IPS_COLS],
                    *[r6(f"{c}_contrib").alias(f"{c}_contrib") for c in IPS_COLS])


@register("assign_strategy", with_panel(IPS_SQL + """
SELECT entity, round(ips, 6) AS ips, round(predictability, 6) AS predictability, strategy FROM strat""",
                                         recursive=True))
def q_assign_strategy(spark, sf):
    s = stages_for(spark, sf).scored
    return s.select("entity", r6("ips").alias("ips"), r6("predictability").alias("predictability"), "strategy")


@register("strategy_parts", with_panel(IPS_SQL + """
SELECT entity, trim(split_part(strategy, '—', 1)) AS action,
       CASE WHEN strategy LIKE '%—%' THEN trim(split_part(strategy, '—', 2)) END AS reason FROM strat""",
                                        recursive=True))
def q_strategy_parts(spark, sf):
    s = stages_for(spark, sf).scored
    return s.select("entity", *RU.strategy_parts("strategy"))


SEG_SQL = IPS_SQL + REGION_SQL


@register_both("segment_sizes", with_panel(SEG_SQL + """
SELECT cluster, cluster_name, count(*) AS n FROM segs GROUP BY 1, 2""", recursive=True))
def q_segment_sizes(seg):
    return seg.rows.groupBy("cluster", "cluster_name").agg(F.count("*").alias("n"))


@register_both("segment_playbook", with_panel(SEG_SQL + """
SELECT cluster, cluster_name, count(*) AS n, CASE cluster_name """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RU.PLAYBOOKS.items())
    + " ELSE '' END AS playbook FROM segs GROUP BY 1, 2", recursive=True))
def q_segment_playbook(seg):
    return seg.rows.groupBy("cluster", "cluster_name").agg(F.count("*").alias("n")) \
        .withColumn("playbook", RU.playbook("cluster_name"))


@register_both("leaderboard", with_panel(SEG_SQL + """
SELECT CAST(row_number() OVER (ORDER BY ips DESC, entity) AS INTEGER) AS position, entity, cluster_name, strategy,
       round(ips, 6) AS ips, 0.0::DOUBLE AS size_log_start, round(size_log_contrib, 6) AS growth_forecast_start,
       round(size_log_contrib + growth_forecast_contrib, 6) AS acceleration_start,
       round(size_log_contrib + growth_forecast_contrib + acceleration_contrib, 6) AS predictability_start
FROM segs QUALIFY position <= 15""", recursive=True))
def q_leaderboard(seg):
    """Entities ordered by index with their stacked contributions
    (running start of each component) and segment/strategy, top 15."""
    s = LK.top_n(seg.rows, 15)
    starts, acc = [], None
    for c in IPS_COLS:
        starts.append(r6(F.lit(0.0) if acc is None else acc).alias(f"{c}_start"))
        acc = F.col(f"{c}_contrib") if acc is None else acc + F.col(f"{c}_contrib")
    return s.select("position", "entity", "cluster_name", "strategy", r6("ips").alias("ips"), *starts)


@register("strategic_matrix", with_panel(IPS_SQL + """, mrow AS (
  SELECT s.entity, s.growth_forecast, m.mean_value FROM strat s
  LEFT JOIN (SELECT entity, avg(value) AS mean_value FROM panel GROUP BY 1) m ON m.entity = s.entity),
mmed AS (SELECT median(mean_value) AS ms, median(growth_forecast) AS mg FROM mrow)
SELECT entity, round(mean_value, 2) AS mean_value, round(growth_forecast, 6) AS growth_forecast,
       CASE WHEN mean_value > ms AND growth_forecast > mg THEN 'GRANDES & CRECIENDO'
            WHEN growth_forecast > mg THEN 'PEQUEÑOS & CRECIENDO'
            WHEN mean_value > ms THEN 'GRANDES & ESTABLES' ELSE 'PEQUEÑOS & ESTABLES' END AS quadrant
FROM mrow, mmed""", recursive=True))
def q_strategic_matrix(spark, sf):
    """Size (mean of all entity rows) x forecast growth by medians."""
    st = stages_for(spark, sf)
    mean_rows = st.panel.groupBy("entity").agg(F.avg("value").alias("mean_value"))
    x = st.scored.select("entity", "growth_forecast").join(mean_rows, "entity", "left")
    q = RU.median_quadrant(x, "mean_value", "growth_forecast", RU.MATRIX_QUADRANTS)
    return q.select("entity", r2("mean_value").alias("mean_value"), r6("growth_forecast").alias("growth_forecast"),
                    "quadrant")


@register("left_out_entities", with_panel(FEAT_SQL + """
SELECT entity, region, concat_ws(',', CASE WHEN growth_forecast IS NULL THEN 'growth_forecast' END,
         CASE WHEN acceleration IS NULL THEN 'acceleration' END, CASE WHEN cv IS NULL THEN 'cv' END,
         CASE WHEN predictability IS NULL THEN 'predictability' END) AS missing
FROM feat WHERE growth_forecast IS NULL OR acceleration IS NULL OR cv IS NULL OR predictability IS NULL""",
                                          recursive=True))
def q_left_out_entities(spark, sf):
    """the entities that clustering and index leave out, and why."""
    return stages_for(spark, sf).left_out()


@register("ips_sensitivity", with_panel(SENS_SQL + """
SELECT component, delta, round(spearman_rho, 6) AS spearman_rho, top10_overlap,
       round(weight_changed_to, 6) AS weight_changed_to FROM sens""", recursive=True))
def q_ips_sensitivity(spark, sf):
    st = stages_for(spark, sf)
    s = SC.sensitivity(st.features)
    return s.select("component", "delta", r6("spearman_rho").alias("spearman_rho"), "top10_overlap",
                    r6("weight_changed_to").alias("weight_changed_to"))


@register("sensitivity_summary", with_panel(SENS_SQL + """
SELECT round(min(spearman_rho), 6) AS rho_min, round(avg(spearman_rho), 6) AS rho_mean,
       min(top10_overlap) AS overlap_min, round(avg(top10_overlap), 4) AS overlap_mean FROM sens""",
                                             recursive=True))
def q_sensitivity_summary(spark, sf):
    """Min / mean of rho and overlap over the scenarios."""
    s = SC.sensitivity(stages_for(spark, sf).features)
    return s.agg(r6(F.min("spearman_rho")).alias("rho_min"), r6(F.avg("spearman_rho")).alias("rho_mean"),
                 F.min("top10_overlap").alias("overlap_min"), r4(F.avg("top10_overlap")).alias("overlap_mean"))
