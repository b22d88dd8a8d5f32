"""Queries of the prepare stage: panel, reshape, metrics, rules, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r2, r4, rnd
from ..operators import metrics as M
from .catalog import register
from .panels import panel_a
from .sqlparts import with_panel


@register("panel_long", with_panel("""
SELECT entity, region, category, t, period_label, round(value, 2) AS value FROM panel"""))
def q_panel_long(spark, sf):
    return panel_a(spark, sf).withColumn("value", r2("value"))


@register("yoy_growth", with_panel("""
SELECT entity, category, t, round(value, 2) AS value,
       round((value / nullif(lag(value) OVER (PARTITION BY entity, category ORDER BY t), 0) - 1) * 100, 4)
         AS yoy_growth_pct
FROM panel"""))
def q_yoy_growth(spark, sf):
    return M.yoy_growth(panel_a(spark, sf)).select(
        "entity", "category", "t", r2("value").alias("value"), r4("yoy_growth_pct").alias("yoy_growth_pct"))


@register("macro_trend", with_panel(""", tot AS (
  SELECT t, period_label, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS total FROM panel GROUP BY 1, 2)
SELECT t, period_label, round(total, 2) AS total,
       round((total / nullif(lag(total) OVER (ORDER BY t), 0) - 1) * 100, 4) AS yoy_pct
FROM tot"""))
def q_macro_trend(spark, sf):
    return M.macro_trend(panel_a(spark, sf)).select(
        "t", "period_label", r2("total").alias("total"), r4("yoy_pct").alias("yoy_pct"))


@register("hhi", with_panel(""", ep AS (
  SELECT entity, t, period_label, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS value
  FROM panel GROUP BY 1, 2, 3),
sh AS (SELECT *, value / nullif(sum(value) OVER (PARTITION BY t), 0) AS share FROM ep)
SELECT t, period_label, round(sum(share * share) * 10000, 4) AS hhi, count(*) AS n_entities
FROM sh GROUP BY 1, 2"""))
def q_hhi(spark, sf):
    return M.hhi(panel_a(spark, sf)).select("t", "period_label", r4("hhi").alias("hhi"), "n_entities")


# ---------------------------------------------------------------- reshape
from pyspark.sql import Window  # noqa: E402

from ..functions.exprs import MONEY, dsum, fmt_magnitude, r6  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..operators import reshape as R  # noqa: E402
from ..operators import rules as C  # noqa: E402
from ..operators.joins import broadcast_if_small, literal_table  # noqa: E402
from ..operators.ranges import quantiles, with_position  # noqa: E402
from ..sources.tables import read_table  # noqa: E402
from .panels import nation_region, panel_a_cells  # noqa: E402
from .stages import stages_for  # noqa: E402

EP = """, ep AS (
  SELECT entity, region, t, period_label, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS value
  FROM panel GROUP BY 1, 2, 3, 4)"""


@register("panel_unpivot", with_panel("""
SELECT entity, category, period_label, round(value, 2) AS value,
       CAST(substr(period_label, 1, 4) AS INTEGER) AS year FROM panel"""))
def q_panel_unpivot(spark, sf):
    wide = R.to_wide(panel_a(spark, sf))
    return R.to_long(wide.drop("total")).select(
        "entity", "category", "period_label", r2("value").alias("value"), "year")


# Columns of the wide tables: the names to show, a parameter as in any report.
ENTITIES = [f"NATION_{i}" for i in range(25)]
CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _other_sql(name, value, shown):
    names = ", ".join(f"'{n}'" for n in shown)
    return f"sum(round({value}, 2)) FILTER (WHERE {name} IS NULL OR {name} NOT IN ({names})) AS OTHER"


@register("panel_pivot_all", with_panel(EP + """
SELECT t, """ + ", ".join(f"sum(round(value, 2)) FILTER (WHERE entity = '{n}') AS {n}" for n in ENTITIES)
                                         + ", " + _other_sql("entity", "value", ENTITIES) + " FROM ep GROUP BY t"))
def q_panel_pivot_all(spark, sf):
    """Shown entities as columns, and the sum of all that have none."""
    ep = M.entity_period(panel_a(spark, sf)).withColumn("value", r2("value"))
    return R.pivot_sum_all(ep, "t", "entity", ENTITIES)


@register("category_pivot_all", with_panel(""", ct AS (
  SELECT t, category, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2)
SELECT t, """ + ", ".join(f"sum(round(v, 2)) FILTER (WHERE category = '{c}') AS {c}" for c in CATEGORIES)
                                            + ", " + _other_sql("category", "v", CATEGORIES) + " FROM ct GROUP BY t"))
def q_category_pivot_all(spark, sf):
    """P5: shown categories as columns, and the sum of all that have none."""
    ct = M.period_totals(panel_a(spark, sf), by=["category"]).select("t", "category", r2("total").alias("v"))
    return R.pivot_sum_all(ct, "t", "category", CATEGORIES, value="v")


@register("region_enrich", """
SELECT c.c_custkey, n.n_name AS entity, coalesce(r.r_name, 'Unknown') AS region
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_region_enrich(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    dim = broadcast_if_small(nation_region(spark, sf).withColumnRenamed("n_nationkey", "c_nationkey"))
    return R.enrich(c, dim, "c_nationkey", ["region"]).select("c_custkey", "entity", "region")


@register("fmt_magnitude", with_panel(EP + """
SELECT entity, t,
  CASE WHEN abs(value) >= 1e9 THEN printf('%.1f', value / 1e9) || 'B'
       WHEN abs(value) >= 1e6 THEN printf('%.0f', value / 1e6) || 'M'
       WHEN abs(value) >= 1e3 THEN printf('%.0f', value / 1e3) || 'K'
       ELSE printf('%.0f', value) END AS label
FROM ep"""))
def q_fmt_magnitude(spark, sf):
    return M.entity_period(panel_a(spark, sf)).select("entity", "t", fmt_magnitude("value").alias("label"))


# ---------------------------------------------------------------- filters
@register("series_lookup", with_panel("""
SELECT entity, category, t, round(value, 2) AS value FROM panel
WHERE entity = 'NATION_3' AND category = 'BUILDING' AND t >= 4"""))
def q_series_lookup(spark, sf):
    p = panel_a(spark, sf)
    return p.filter((F.col("entity") == "NATION_3") & (F.col("category") == "BUILDING") & (F.col("t") >= 4)) \
        .select("entity", "category", "t", r2("value").alias("value"))


PROBE = [("NATION_3", 1), ("nation_7", 2), ("NATION_99", 3), ("ATLANTIS", 4), ("NATION_24", 5)]


@register("membership_probe", with_panel(""", names(name, ord) AS (VALUES """
          + ", ".join(f"('{n}', {i})" for n, i in PROBE) + """),
ents AS (SELECT DISTINCT entity FROM panel)
SELECT n.name, CAST(n.ord AS INTEGER) AS ord, e.entity IS NOT NULL AS present
FROM names n LEFT JOIN ents e ON e.entity = n.name"""))
def q_membership_probe(spark, sf):
    names = literal_table(spark, PROBE, "name string, ord int")
    ents = panel_a(spark, sf).select("entity").distinct()
    return names.join(ents, names.name == ents.entity, "left") \
        .select("name", "ord", F.col("entity").isNotNull().alias("present"))


TRIM_SQL = """, tr AS (
  SELECT *, min(CASE WHEN value > 0 THEN t END) OVER (PARTITION BY entity, category) AS t_first FROM panel),
trimmed AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY entity, category) AS BIGINT) AS n_obs FROM tr WHERE t >= t_first)"""


@register("trim_leading_zeros", with_panel(TRIM_SQL + """
SELECT entity, category, t, round(value, 2) AS value, t_first, n_obs FROM trimmed"""))
def q_trim_leading_zeros(spark, sf):
    return M.trim_leading_zeros(panel_a(spark, sf)).select(
        "entity", "category", "t", r2("value").alias("value"), "t_first", "n_obs")


# ---------------------------------------------------------------- metrics
@register("entity_period", with_panel(EP + """
SELECT entity, region, t, period_label, round(value, 2) AS value FROM ep"""))
def q_entity_period(spark, sf):
    return M.entity_period(panel_a(spark, sf)).withColumn("value", r2("value"))


@register("regional_index", with_panel(""", rt AS (
  SELECT region, t, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS total FROM panel GROUP BY 1, 2),
x AS (SELECT *, arg_min(total, t) OVER (PARTITION BY region) AS base,
             arg_max(total, t) OVER (PARTITION BY region) AS fin FROM rt)
SELECT region, t, round(total, 2) AS total, round(total / nullif(base, 0) * 100, 4) AS index_base100,
       round(fin / nullif(base, 0), 6) AS multiplier FROM x"""))
def q_regional_index(spark, sf):
    return M.regional_index(panel_a(spark, sf)).select(
        "region", "t", r2("total").alias("total"), r4("index_base100").alias("index_base100"),
        r6("multiplier").alias("multiplier"))


ESTATS_SQL = EP + """, es AS (
  SELECT entity, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS mn, max(value) AS mx
  FROM ep GROUP BY 1)"""


@register("entity_stats", with_panel(ESTATS_SQL + """
SELECT entity, round(mean, 2) AS mean, round(std, 2) AS std, round(mn, 2) AS min, round(mx, 2) AS max,
       round(std / nullif(mean, 0), 6) AS cv, round(log10(greatest(mean, 1)), 6) AS size_log FROM es"""))
def q_entity_stats(spark, sf):
    s = M.entity_stats(panel_a(spark, sf))
    return s.select("entity", r2("mean").alias("mean"), r2("std").alias("std"), r2("min").alias("min"),
                    r2("max").alias("max"), r6("cv").alias("cv"), r6("size_log").alias("size_log"))


WM_SQL = """, wm AS (
  SELECT entity, category, avg(value) AS mean_value, stddev_samp(value) AS std_value
  FROM panel GROUP BY 1, 2)"""


@register("wide_metrics", with_panel(WM_SQL + """
SELECT entity, category, round(mean_value, 2) AS mean_value, round(std_value, 2) AS std_value,
       round(std_value / nullif(mean_value, 0), 6) AS cv_value FROM wm"""))
def q_wide_metrics(spark, sf):
    return M.wide_metrics(panel_a(spark, sf)).select(
        "entity", "category", r2("mean_value").alias("mean_value"), r2("std_value").alias("std_value"),
        r6("cv_value").alias("cv_value"))


CAGR_SQL = """, span AS (SELECT max(t) AS t_last FROM panel),
ends AS (
  SELECT entity, category, t_last, CAST(floor((t_last + 1) / 2) AS INTEGER) AS h,
         max(CASE WHEN t = 0 THEN value END) AS v0,
         max(CASE WHEN t = CAST(floor((t_last + 1) / 2) AS INTEGER) THEN value END) AS vm,
         max(CASE WHEN t = t_last THEN value END) AS v1
  FROM panel, span GROUP BY 1, 2, 3, 4),
cg AS (
  SELECT entity, category,
    (pow(nullif(vm, 0) / nullif(v0, 0), 1.0 / h) - 1) * 100 AS cagr_first_half,
    (pow(nullif(v1, 0) / nullif(vm, 0), 1.0 / (t_last - h)) - 1) * 100 AS cagr_second_half,
    (pow(nullif(v1, 0) / nullif(v0, 0), 1.0 / t_last) - 1) * 100 AS cagr_full
  FROM ends)"""


@register("cagr_halves", with_panel(CAGR_SQL + """
SELECT entity, category, round(cagr_first_half, 4) AS cagr_first_half,
       round(cagr_second_half, 4) AS cagr_second_half, round(cagr_full, 4) AS cagr_full FROM cg"""))
def q_cagr_halves(spark, sf):
    return M.cagr_halves(panel_a(spark, sf)).select(
        "entity", "category", *[r4(c).alias(c) for c in ("cagr_first_half", "cagr_second_half", "cagr_full")])


HIST_SQL = EP + """, etr AS (
  SELECT *, min(CASE WHEN value > 0 THEN t END) OVER (PARTITION BY entity) AS t_first FROM ep),
eg AS (
  SELECT entity, arg_min(value, t) AS v0, arg_max(value, t) AS v1, count(*) - 1 AS steps
  FROM etr WHERE t >= t_first GROUP BY 1),
hist AS (
  SELECT e.entity, CASE WHEN steps >= 5 AND v0 > 0
    THEN (pow(nullif(v1, 0) / nullif(v0, 0), 1.0 / steps) - 1) * 100 END AS growth_historical
  FROM (SELECT DISTINCT entity FROM ep) e JOIN eg ON e.entity = eg.entity)"""


@register("cagr_historical", with_panel(HIST_SQL + """
SELECT entity, round(growth_historical, 4) AS growth_historical FROM hist"""))
def q_cagr_historical(spark, sf):
    return M.cagr_historical(panel_a(spark, sf)).select(
        "entity", r4("growth_historical").alias("growth_historical"))


@register("share_change", with_panel(""", span AS (SELECT max(t) AS t_last FROM panel),
g AS (SELECT entity, category, max(CASE WHEN t = 0 THEN value END) AS v0,
             max(CASE WHEN t = t_last THEN value END) AS v1 FROM panel, span GROUP BY 1, 2),
tot AS (SELECT CAST(sum(CAST(CASE WHEN t = 0 THEN value END AS DECIMAL(20,2))) AS DOUBLE) AS tot0,
               CAST(sum(CAST(CASE WHEN t = t_last THEN value END AS DECIMAL(20,2))) AS DOUBLE) AS tot1
        FROM panel, span)
SELECT entity, category, round(v0 / nullif(tot0, 0) * 100, 6) AS share_first,
       round(v1 / nullif(tot1, 0) * 100, 6) AS share_last,
       round(v1 / nullif(tot1, 0) * 100 - v0 / nullif(tot0, 0) * 100, 6) AS share_change
FROM g, tot"""))
def q_share_change(spark, sf):
    return M.share_change(panel_a(spark, sf)).select(
        "entity", "category", *[r6(c).alias(c) for c in ("share_first", "share_last", "share_change")])


SHARE_SQL = EP + """, sh AS (
  SELECT entity, t, value / nullif(sum(value) OVER (PARTITION BY t), 0) * 100 AS share FROM ep)"""


@register("top_share_rest", with_panel(SHARE_SQL + """,
mean AS (SELECT entity, avg(share) AS ms FROM sh GROUP BY 1),
tops AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY ms DESC, entity) AS rk FROM mean)
         WHERE rk <= 8),
ts AS (SELECT t, entity, share FROM sh WHERE entity IN (SELECT entity FROM tops))
SELECT t, entity, round(share, 6) AS share FROM ts
UNION ALL SELECT t, 'Rest' AS entity, round(100 - sum(share), 6) AS share FROM ts GROUP BY t"""))
def q_top_share_rest(spark, sf):
    return M.top_share_rest(panel_a(spark, sf)).select("t", "entity", r6("share").alias("share"))


@register("own_max_profile", with_panel(EP + """, x AS (
  SELECT *, value / nullif(max(value) OVER (PARTITION BY entity), 0) * 100 AS pct_of_max,
         avg(value) OVER (PARTITION BY entity) AS mean FROM ep),
ent AS (SELECT DISTINCT entity, region, mean FROM x),
rr AS (SELECT region, row_number() OVER (ORDER BY sum(mean) DESC, region) AS region_rank FROM ent GROUP BY 1),
ord AS (SELECT entity, row_number() OVER (ORDER BY region_rank, mean DESC, entity) AS ord
        FROM ent JOIN rr USING (region))
SELECT x.entity, x.region, x.t, round(x.pct_of_max, 6) AS pct_of_max, CAST(ord.ord AS INTEGER) AS ord
FROM x JOIN ord USING (entity)"""))
def q_own_max_profile(spark, sf):
    return M.own_max_profile(panel_a(spark, sf)).select(
        "entity", "region", "t", r6("pct_of_max").alias("pct_of_max"), F.col("ord").cast("int").alias("ord"))


@register("category_mix", with_panel(""", span AS (SELECT max(t) AS t_last FROM panel),
g AS (SELECT category,
        CAST(sum(CAST(CASE WHEN t = 0 THEN value END AS DECIMAL(20,2))) AS DOUBLE) AS v0,
        CAST(sum(CAST(CASE WHEN t = t_last THEN value END AS DECIMAL(20,2))) AS DOUBLE) AS v1
      FROM panel, span GROUP BY 1),
s AS (SELECT category, v1 / nullif(sum(v1) OVER (), 0) * 100 AS share_last,
             v0 / nullif(sum(v0) OVER (), 0) * 100 AS share_first FROM g)
SELECT category, round(share_last, 6) AS share_last, round(share_first, 6) AS share_first,
       round(share_last - share_first, 6) AS delta_pts FROM s"""))
def q_category_mix(spark, sf):
    return M.category_mix(panel_a(spark, sf)).select(
        "category", *[r6(c).alias(c) for c in ("share_last", "share_first", "delta_pts")])


MACRO_SQL = """, tot AS (
  SELECT t, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS total FROM panel GROUP BY 1),
mt AS (SELECT t, total, (total / nullif(lag(total) OVER (ORDER BY t), 0) - 1) * 100 AS yoy_pct FROM tot)"""


@register("macro_kpis", with_panel(MACRO_SQL + """, g AS (
  SELECT arg_min(total, t) AS first_total, arg_max(total, t) AS last_total, max(t) - min(t) AS steps,
         arg_max(yoy_pct, t) AS last_yoy_pct FROM mt)
SELECT round(first_total, 2) AS first_total, round(last_total, 2) AS last_total,
       round((last_total / nullif(first_total, 0) - 1) * 100, 4) AS total_growth_pct,
       round((pow(nullif(last_total, 0) / nullif(first_total, 0), 1.0 / steps) - 1) * 100, 4) AS cagr_pct,
       round(last_yoy_pct, 4) AS last_yoy_pct FROM g"""))
def q_macro_kpis(spark, sf):
    k = M.macro_kpis(panel_a(spark, sf))
    return k.select(r2("first_total").alias("first_total"), r2("last_total").alias("last_total"),
                    *[r4(c).alias(c) for c in ("total_growth_pct", "cagr_pct", "last_yoy_pct")])


MILESTONES = [(4, "first full year"), (12, "mid span"), (26, "last quarter"), (40, "beyond data")]


@register("milestones", with_panel(MACRO_SQL + """, ms(t, label) AS (VALUES """
          + ", ".join(f"({t}, '{lbl}')" for t, lbl in MILESTONES) + """)
SELECT CAST(ms.t AS INTEGER) AS t, ms.label, round(mt.total, 2) AS total FROM ms JOIN mt ON mt.t = ms.t"""))
def q_milestones(spark, sf):
    ms = literal_table(spark, MILESTONES, "t int, label string")
    mt = M.macro_trend(panel_a(spark, sf))
    return F.broadcast(ms).join(mt, "t").select("t", "label", r2("total").alias("total"))


# ---------------------------------------------------------------- rule tables
GQ = C.GROWTH_QUADRANTS


def _quad_sql(x, y, labels, xc="0", yc="0"):
    return (f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL "
            f"WHEN {x} > {xc} AND {y} > {yc} THEN '{labels[0]}' WHEN {y} > {yc} THEN '{labels[1]}' "
            f"WHEN {x} > {xc} THEN '{labels[2]}' ELSE '{labels[3]}' END")


@register("growth_quadrant", with_panel(WM_SQL + CAGR_SQL + """
SELECT wm.entity, wm.category, round(cagr_first_half, 4) AS cagr_first_half,
       round(cagr_second_half, 4) AS cagr_second_half, """
          + _quad_sql("cagr_first_half", "cagr_second_half", GQ) + """ AS quadrant
FROM wm JOIN cg ON wm.entity = cg.entity AND wm.category = cg.category
WHERE mean_value > 500000 AND cagr_first_half IS NOT NULL AND cagr_second_half IS NOT NULL"""))
def q_growth_quadrant(spark, sf):
    p = panel_a(spark, sf)
    x = M.wide_metrics(p).join(M.cagr_halves(p), ["entity", "category"])
    return C.growth_quadrant(x).select("entity", "category", r4("cagr_first_half").alias("cagr_first_half"),
                                       r4("cagr_second_half").alias("cagr_second_half"), "quadrant")


@register("volatility_quadrant", with_panel(WM_SQL + """, f AS (
  SELECT entity, category, mean_value, std_value / nullif(mean_value, 0) AS cv_value FROM wm
  WHERE mean_value > 100000),
med AS (SELECT median(mean_value) AS ms, median(cv_value) AS mc FROM f)
SELECT entity, category, round(mean_value, 2) AS mean_value, round(cv_value, 6) AS cv_value, """
          + _quad_sql("mean_value", "cv_value", C.VOLATILITY_QUADRANTS, "ms", "mc") + """ AS quadrant
FROM f, med"""))
def q_volatility_quadrant(spark, sf):
    wm = M.wide_metrics(panel_a(spark, sf))
    x = C.median_quadrant(wm, "mean_value", "cv_value", C.VOLATILITY_QUADRANTS, min_size=100000.0)
    return x.select("entity", "category", r2("mean_value").alias("mean_value"),
                    r6("cv_value").alias("cv_value"), "quadrant")


@register("quadrants_median", with_panel(WM_SQL + CAGR_SQL + """
SELECT round(median(mean_value), 2) AS median_mean, round(median(std_value / nullif(mean_value, 0)), 6) AS median_cv,
       round(median(cagr_first_half), 4) AS median_cagr_first, round(median(cagr_second_half), 4) AS median_cagr_second
FROM wm JOIN cg ON wm.entity = cg.entity AND wm.category = cg.category"""))
def q_quadrants_median(spark, sf):
    p = panel_a(spark, sf)
    x = M.wide_metrics(p).join(M.cagr_halves(p), ["entity", "category"])
    cols = ["mean_value", "cv_value", "cagr_first_half", "cagr_second_half"]
    m = {c: F.col(f"_q_{c}")[0] for c in cols}
    return quantiles(x, cols, [0.5]).select(
        r2(m["mean_value"]).alias("median_mean"), r6(m["cv_value"]).alias("median_cv"),
        r4(m["cagr_first_half"]).alias("median_cagr_first"), r4(m["cagr_second_half"]).alias("median_cagr_second"))


@register("notable_entities", with_panel(WM_SQL + CAGR_SQL + """, x AS (
  SELECT wm.entity, wm.category, mean_value, cagr_second_half FROM wm
  JOIN cg ON wm.entity = cg.entity AND wm.category = cg.category),
u AS (
  (SELECT entity, category FROM x ORDER BY mean_value DESC, entity, category LIMIT 6)
  UNION ALL
  (SELECT entity, category FROM x WHERE cagr_second_half IS NOT NULL
   ORDER BY cagr_second_half DESC, entity, category LIMIT 4)
  UNION ALL
  (SELECT entity, category FROM x WHERE cagr_second_half IS NOT NULL
   ORDER BY cagr_second_half ASC, entity, category LIMIT 3))
SELECT DISTINCT entity, category FROM u"""))
def q_notable_entities(spark, sf):
    """Largest series, fastest and slowest growing ones, each once."""
    p = stages_for(spark, sf).panel
    x = M.wide_metrics(p).join(M.cagr_halves(p), ["entity", "category"])
    return Q.top_lists(x, ["entity", "category"], [
        ("largest", "mean_value", True, 6), ("fastest", "cagr_second_half", True, 4),
        ("slowest", "cagr_second_half", False, 3)]).select("entity", "category").distinct()


@register("notable_by_volatility", with_panel(WM_SQL + """, x AS (
  SELECT entity, category, mean_value, std_value / nullif(mean_value, 0) AS cv_value FROM wm),
u AS (
  SELECT 0 AS list, row_number() OVER (ORDER BY mean_value DESC, entity, category) AS rank, * FROM x
  UNION ALL
  SELECT 1, row_number() OVER (ORDER BY cv_value DESC, entity, category), * FROM x WHERE cv_value IS NOT NULL
  UNION ALL
  SELECT 2, row_number() OVER (ORDER BY cv_value, entity, category), * FROM x WHERE cv_value IS NOT NULL)
SELECT entity, arg_min(category, (list, rank)) AS category FROM u
WHERE rank <= CASE list WHEN 0 THEN 8 ELSE 3 END GROUP BY entity"""))
def q_notable_by_volatility(spark, sf):
    """The 8 largest series, the 3 most and the 3 least volatile ones; an
    entity is named once, by its first series."""
    x = M.wide_metrics(stages_for(spark, sf).panel)
    found = Q.top_lists(x, ["entity", "category"], [("largest", "mean_value", True, 8), ("volatile", "cv_value", True, 3),
                                                    ("steady", "cv_value", False, 3)])
    return found.groupBy("entity").agg(F.min_by("category", F.struct("list", "rank")).alias("category"))


@register("share_bands", with_panel(SHARE_SQL + """, last AS (
  SELECT entity, share FROM sh WHERE t = (SELECT max(t) FROM sh)),
b AS (SELECT entity, share, sum(share) OVER (ORDER BY share DESC, entity ROWS UNBOUNDED PRECEDING) AS cum
      FROM last)
SELECT entity, round(share, 6) AS share, round(cum - share, 6) AS band_start,
       round(cum - share / 2, 6) AS band_center FROM b"""))
def q_share_bands(spark, sf):
    ep = M.entity_period(panel_a(spark, sf))
    sh = M.with_period_share(ep).withColumn("share", F.col("share") * 100)
    last = sh.join(F.broadcast(sh.agg(F.max("t").alias("t"))), "t")        # one period
    b = with_position(last, [F.desc("share"), "entity"], total="share") \
        .withColumn("cum", F.col("before") + F.col("share"))
    return b.select("entity", r6("share").alias("share"), r6(F.col("cum") - F.col("share")).alias("band_start"),
                    r6(F.col("cum") - F.col("share") / 2).alias("band_center"))


@register("top10_share", with_panel(SHARE_SQL + """
SELECT round(sum(share), 6) AS top10_share_pct FROM (
  SELECT share, row_number() OVER (ORDER BY share DESC, entity) AS rk FROM sh
  WHERE t = (SELECT max(t) FROM sh)) WHERE rk <= 10"""))
def q_top10_share(spark, sf):
    ep = M.entity_period(panel_a(spark, sf))
    sh = M.with_period_share(ep).withColumn("share", F.col("share") * 100)
    last = sh.join(F.broadcast(sh.agg(F.max("t").alias("t"))), "t")
    top = last.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("share"), "entity"))) \
        .filter(F.col("rk") <= 10)
    return top.agg(r6(F.sum("share")).alias("top10_share_pct"))


@register("series_trend", with_panel(TRIM_SQL + """, s AS (
  SELECT entity, category, count(*) AS n, CAST(sum(t) AS DOUBLE) AS st, CAST(sum(t * t) AS DOUBLE) AS stt,
    CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS sy,
    CAST(sum(CAST(value AS DECIMAL(20,2)) * t) AS DOUBLE) AS sty
  FROM trimmed GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n >= 2 AND n * stt - st * st <> 0
                     THEN (n * sty - st * sy) / (n * stt - st * st) ELSE 0.0 END AS slope FROM s)
SELECT entity, category, CAST(n AS INTEGER) AS n_obs, round(slope, 4) AS slope,
       round((sy - slope * st) / n, 2) AS intercept FROM f"""))
def q_series_trend(spark, sf):
    return M.series_trend(panel_a(spark, sf)).select(
        "entity", "category", "n_obs", r4("slope").alias("slope"), r2("intercept").alias("intercept"))


# ---------------------------------------------------------------- quality
def _wide(spark, sf):
    return R.to_wide(panel_a(spark, sf))


@register("panel_audit", with_panel("""
SELECT count(*) AS n_rows, CAST(3 + (SELECT count(DISTINCT t) FROM panel) AS INTEGER) AS n_columns,
       count(DISTINCT entity) AS n_entities, CAST((SELECT count(DISTINCT t) FROM panel) AS INTEGER) AS n_periods,
       (SELECT min_by(period_label, t) FROM panel) AS first_period,
       (SELECT max_by(period_label, t) FROM panel) AS last_period,
       CAST(0 AS BIGINT) AS n_nulls, count(*) - count(DISTINCT (entity, category)) AS n_duplicates,
       (SELECT count(*) FILTER (WHERE value < 0) FROM panel) AS n_negative,
       (SELECT count(*) FROM (SELECT DISTINCT entity FROM panel) p
        WHERE entity NOT IN (SELECT n_name FROM nation)) AS n_unmapped
FROM (SELECT DISTINCT entity, category FROM panel)"""))
def q_panel_audit(spark, sf):
    known = nation_region(spark, sf).select("entity")
    out = Q.audit_summary(_wide(spark, sf), known)
    return out.withColumn("n_columns", F.col("n_columns").cast("int")).withColumn(
        "n_periods", F.col("n_periods").cast("int"))


#: table: its columns, its key, columns that should not be negative, and
#: foreign keys (column, table, its column)
RAW_TABLES = {
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
               ["o_orderkey"], ["o_totalprice"], [("o_custkey", "customer", "c_custkey")]),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                 ["c_custkey"], ["c_acctbal"], [("c_nationkey", "nation", "n_nationkey")]),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax", "l_shipdate"],
                 ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                 [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"),
                  ("l_suppkey", "supplier", "s_suppkey")]),
    "events": (["event_id", "ts", "user_id", "event_type", "value"], ["event_id"], ["value"], []),
}


def _raw_audit_sql():
    lines = []
    for t, (cols, key, negative, references) in RAW_TABLES.items():
        line = lambda check, column, n, t=t: lines.append(
            f"""SELECT '{t}' AS "table", '{check}' AS "check", {column} AS "column", CAST(({n}) AS BIGINT) AS n""")
        line("rows", "CAST(NULL AS VARCHAR)", f"SELECT count(*) FROM {t}")
        for c in cols:
            line("nulls", f"'{c}'", f"SELECT count(*) - count({c}) FROM {t}")
        for c in negative:
            line("negative", f"'{c}'", f"SELECT count(*) FROM {t} WHERE {c} < 0")
        line("duplicates", f"'{','.join(key)}'",
             f"SELECT (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM {t}))")
        for c, other, k in references:
            line("unmapped", f"'{c}'",
                 f"SELECT count(*) FROM {t} a WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} b WHERE b.{k} = a.{c})")
    return " UNION ALL ".join(lines)


@register("raw_audit", _raw_audit_sql())
def q_raw_audit(spark, sf):
    """The audit on the input tables themselves, before any panel is made."""
    out = None
    for t, (cols, key, negative, references) in RAW_TABLES.items():
        one = Q.audit_raw(read_table(spark, sf, t, *cols), t, key, negative,
                          [(c, read_table(spark, sf, other, k), k) for c, other, k in references])
        out = one if out is None else out.unionByName(one)
    return out


@register("category_counts", with_panel("""
SELECT category, count(*) AS n FROM (SELECT DISTINCT entity, category FROM panel) GROUP BY 1"""))
def q_category_counts(spark, sf):
    """Series by category, the most frequent first."""
    return Q.value_counts(panel_a_cells(spark, sf).select("entity", "category").distinct(), "category")


def declared_totals(spark, sf):
    """Second source for V4: series totals recomputed from line items.

    Line items are pre-aggregated by order (map-side) before the join with
    orders, so a hot order key never moves as raw rows."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_tax", "l_discount")
    cents = "decimal(20,2)"              # the input's own scale, so that products stay exact
    amt = (F.col("l_extendedprice").cast(cents) * (1 + F.col("l_tax").cast(cents))
           * (1 - F.col("l_discount").cast(cents)))
    per_order = li.groupBy("l_orderkey").agg(F.sum(amt).alias("amt"))
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    per_cust = per_order.join(o, per_order.l_orderkey == o.o_orderkey) \
        .groupBy("o_custkey").agg(F.sum("amt").alias("amt"))
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    per_seg = per_cust.join(c, per_cust.o_custkey == c.c_custkey) \
        .groupBy("c_nationkey", F.col("c_mktsegment").alias("category")).agg(F.sum("amt").alias("amt"))
    nr = broadcast_if_small(nation_region(spark, sf))
    return per_seg.join(nr, per_seg.c_nationkey == nr.n_nationkey) \
        .select("entity", "category", rnd(F.col("amt").cast("double"), 2).alias("declared_total"))


DECL_SQL = """, decl AS (
  SELECT n.n_name AS entity, c.c_mktsegment AS category,
    round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2)) * (1 + CAST(l_tax AS DECIMAL(20,2)))
                   * (1 - CAST(l_discount AS DECIMAL(20,2)))) AS DOUBLE), 2) AS declared_total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2),
comp AS (SELECT entity, category, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS computed_total
         FROM panel GROUP BY 1, 2),
cons AS (SELECT abs(computed_total - declared_total) / nullif(declared_total, 0) * 100 AS diff_pct
         FROM comp JOIN decl USING (entity, category)),
consum AS (SELECT count(*) AS n_series, round(max(diff_pct), 4) AS max_pct_diff,
                  count(*) FILTER (WHERE diff_pct > 1) AS n_inconsistent_above_1pct FROM cons)"""


def _consistency(spark, sf):
    comp = M.period_totals(panel_a(spark, sf).withColumn("period_label", F.lit("")), by=["entity", "category"]) \
        .groupBy("entity", "category").agg(dsum("total").alias("computed_total"))
    c = Q.total_consistency(comp, declared_totals(spark, sf))
    return c.agg(F.count("*").alias("n_series"), r4(F.max("diff_pct")).alias("max_pct_diff"),
                 F.count_if(F.col("diff_pct") > 1).alias("n_inconsistent_above_1pct"))


@register("total_consistency", with_panel(DECL_SQL + " SELECT * FROM consum"))
def q_total_consistency(spark, sf):
    return _consistency(spark, sf)


ZERO_SQL = """, z AS (SELECT DISTINCT entity FROM panel WHERE value = 0)"""


@register("zero_entities", with_panel(ZERO_SQL + " SELECT entity FROM z"))
def q_zero_entities(spark, sf):
    return Q.zero_entities(panel_a(spark, sf))


@register("zero_entity_count", with_panel(ZERO_SQL + " SELECT count(*) AS n_entities FROM z"))
def q_zero_entity_count(spark, sf):
    return Q.zero_entities(panel_a(spark, sf)).agg(F.count("*").alias("n_entities"))


@register("audit_report", with_panel(DECL_SQL + ZERO_SQL + ", raw AS (" + _raw_audit_sql() + """), au AS (
  SELECT sum(n) FILTER (WHERE "check" = 'nulls') AS nulls, sum(n) FILTER (WHERE "check" = 'duplicates') AS duplicates,
         sum(n) FILTER (WHERE "check" = 'negative') AS negative, sum(n) FILTER (WHERE "check" = 'unmapped') AS unmapped
  FROM raw)
SELECT 'nulls' AS "check", CAST(nulls AS DOUBLE) AS value, CASE WHEN nulls = 0 THEN 'pass' ELSE 'fail' END AS status FROM au
UNION ALL SELECT 'duplicate_keys', CAST(duplicates AS DOUBLE), CASE WHEN duplicates = 0 THEN 'pass' ELSE 'fail' END FROM au
UNION ALL SELECT 'total_max_pct_diff', max_pct_diff, CASE WHEN max_pct_diff < 0.01 THEN 'pass' ELSE 'review' END FROM consum
UNION ALL SELECT 'entities_with_zeros', CAST(count(*) AS DOUBLE), 'warn' FROM z
UNION ALL SELECT 'negative_values', CAST(negative AS DOUBLE), CASE WHEN negative = 0 THEN 'pass' ELSE 'fail' END FROM au
UNION ALL SELECT 'unmapped_keys', CAST(unmapped AS DOUBLE), CASE WHEN unmapped = 0 THEN 'pass' ELSE 'warn' END FROM au"""))
def q_audit_report(spark, sf):
    """V8 over the input tables as they are read."""
    return Q.audit_report(q_raw_audit(spark, sf), _consistency(spark, sf), Q.zero_entities(panel_a(spark, sf)))


# ---------------------------------------------------------------- Panel B
@register("panel_b_long", with_panel("""
SELECT entity, region, category, t, period_label, round(value, 2) AS value FROM panel_b""", b=True))
def q_panel_b_long(spark, sf):
    from .panels import panel_b
    return panel_b(spark, sf).withColumn("value", r2("value"))
