"""Growth, share and concentration metrics.

Windows are always partitioned by the series key (or computed on a result
whose grain is the period, which is small by construction: at most one row
per period).  Totals that every row needs are one-row aggregates joined with
an explicit broadcast: a global aggregate has exactly one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cagr, dsum, pct_change, ratio
from .joins import broadcast_if_small
from .ranges import with_position

SERIES = ["entity", "category"]


def yoy_growth(panel: DataFrame, keys=SERIES) -> DataFrame:
    """Period-over-period growth % per series; x/0 -> NULL."""
    w = Window.partitionBy(*keys).orderBy("t")
    return panel.withColumn("yoy_growth_pct", pct_change(F.col("value"), F.lag("value").over(w)))


def period_totals(panel: DataFrame, by=()) -> DataFrame:
    """A1/A3/A4: exact sum of value by period (and optional keys)."""
    return panel.groupBy("t", "period_label", *by).agg(dsum("value").alias("total"))


def macro_trend(panel: DataFrame) -> DataFrame:
    """A1 + G2: total per period and its growth %.

    The lag runs on the period-grain result (one row per period), a window
    over a bounded number of rows.
    """
    tot = period_totals(panel)
    w = Window.orderBy("t")
    return tot.withColumn("yoy_pct", pct_change(F.col("total"), F.lag("total").over(w)))


def entity_period(panel: DataFrame) -> DataFrame:
    """A2: collapse categories: sum by (entity, period)."""
    return panel.groupBy("entity", "region", "t", "period_label").agg(dsum("value").alias("value"))


def with_period_share(df: DataFrame, part: str = "entity") -> DataFrame:
    """Share (0..1) of each ``part`` in its period total (A16, G8).  Totals
    are summed map-side and, being one row per period, sent to the rows where
    their estimated size allows it (else AQE decides by the real one); no task
    meets all entities of a period."""
    total = df.groupBy("t").agg(F.sum("value").alias("_total"))
    return df.join(broadcast_if_small(total), "t").withColumn("share", ratio(F.col("value"), F.col("_total"))).select(*df.columns, "share")


def hhi(panel: DataFrame) -> DataFrame:
    """Herfindahl-Hirschman index per period, sum(share^2) * 10000.

    Two aggregation levels: entity sums per period, then the share sum per
    period.
    """
    ep = with_period_share(entity_period(panel))
    return ep.groupBy("t", "period_label").agg(
        (F.sum(F.col("share") * F.col("share")) * 10000).alias("hhi"),
        F.count("*").alias("n_entities"))


def cagr_halves(wide_long: DataFrame, keys=SERIES) -> DataFrame:
    """CAGR over first half, second half and full span of the periods.

    half = P // 2 with P periods; exponents half, P-1-half, P-1; a zero
    endpoint gives NULL.  Endpoints are picked with conditional aggregates,
    so one pass over the long table suffices.
    """
    span = wide_long.agg(F.max("t").alias("t_last"))
    x = wide_long.crossJoin(F.broadcast(span))
    half = F.floor((F.col("t_last") + 1) / 2)
    g = x.groupBy(*keys).agg(
        F.max(F.when(F.col("t") == 0, F.col("value"))).alias("v_first"),
        F.max(F.when(F.col("t") == half, F.col("value"))).alias("v_mid"),
        F.max(F.when(F.col("t") == F.col("t_last"), F.col("value"))).alias("v_last"),
        F.first("t_last").alias("t_last"))
    h = F.floor((F.col("t_last") + 1) / 2)
    return g.select(
        *keys,
        cagr(F.nullif("v_mid", F.lit(0)), F.nullif("v_first", F.lit(0)), h).alias("cagr_first_half"),
        cagr(F.nullif("v_last", F.lit(0)), F.nullif("v_mid", F.lit(0)), F.col("t_last") - h).alias("cagr_second_half"),
        cagr(F.nullif("v_last", F.lit(0)), F.nullif("v_first", F.lit(0)), F.col("t_last")).alias("cagr_full"))


def trim_leading_zeros(panel: DataFrame, keys=SERIES) -> DataFrame:
    """keep each series from its first value > 0; all-zero series vanish.

    Adds ``t_first`` (first non-zero period) and ``n_obs`` (points kept).
    """
    w = Window.partitionBy(*keys)
    x = panel.withColumn("t_first", F.min(F.when(F.col("value") > 0, F.col("t"))).over(w))
    x = x.filter(F.col("t") >= F.col("t_first"))
    return x.withColumn("n_obs", F.count(F.lit(1)).over(w))


def ordered_points(x, y="value"):
    """Aggregate: a series' points as an array of (x, y) in the order of x.
    Sums over it have one order, so fits don't depend on partitioning and
    need no rounding of the values."""
    return F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))


def with_line(df: DataFrame, points: str, p: str) -> DataFrame:
    """Least-squares line of an array of (x, y): adds ``{p}_n``, slope
    ``{p}_b`` (0 for fewer than two points or equal x), intercept ``{p}_a`` and
    ``{p}_sd``, the population standard deviation of the residuals.

    Moments are taken about the means and residuals from the fitted line, so
    nothing cancels where values are large against their spread."""
    def total(term):
        return F.aggregate(F.col(points), F.lit(0.0), lambda acc, q: acc + term(q["x"], q["y"]))

    n, mx, my, sxx, a, b = (F.col(f"{p}_{c}") for c in ("n", "mx", "my", "sxx", "a", "b"))
    some = F.nullif(n, F.lit(0.0))
    df = df.withColumn(f"{p}_n", F.size(points).cast("double"))
    df = df.withColumns({f"{p}_mx": total(lambda x, y: x) / some, f"{p}_my": total(lambda x, y: y) / some})
    df = df.withColumns({f"{p}_sxx": total(lambda x, y: (x - mx) * (x - mx)),
                         f"{p}_sxy": total(lambda x, y: (x - mx) * (y - my))})
    df = df.withColumn(f"{p}_b", F.when((n >= 2) & (sxx != 0), F.try_divide(f"{p}_sxy", sxx)).otherwise(F.lit(0.0)))
    df = df.withColumn(f"{p}_a", my - b * mx)
    df = df.withColumn(f"{p}_sd", F.sqrt(total(lambda x, y: (y - a - b * x) * (y - a - b * x)) / some))
    return df.drop(f"{p}_mx", f"{p}_my", f"{p}_sxx", f"{p}_sxy")


def series_trend(panel: DataFrame, keys=SERIES) -> DataFrame:
    """OLS slope/intercept of value on t per series (after F6)."""
    tr = trim_leading_zeros(panel, keys)
    g = with_line(tr.groupBy(*keys).agg(ordered_points("t").alias("_pts")), "_pts", "f")
    return g.select(*keys, F.col("f_n").cast("int").alias("n_obs"), F.col("f_b").alias("slope"),
                    F.col("f_a").alias("intercept"))


def entity_stats(panel: DataFrame) -> DataFrame:
    """Mean, sample std, min, max and CV of the entity-period sums;
    ``size_log`` = log10(max(mean, 1))."""
    ep = entity_period(panel)
    g = ep.groupBy("entity").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                 F.min("value").alias("min"), F.max("value").alias("max"))
    return g.withColumn("cv", ratio(F.col("std"), F.col("mean"))) \
        .withColumn("size_log", F.log10(F.greatest(F.col("mean"), F.lit(1.0))))


def wide_metrics(panel: DataFrame, keys=SERIES) -> DataFrame:
    """Per-series mean/std/CV across periods, from the long table."""
    g = panel.groupBy(*keys).agg(F.avg("value").alias("mean_value"),
                                 F.stddev_samp("value").alias("std_value"))
    return g.withColumn("cv_value", ratio(F.col("std_value"), F.col("mean_value")))


def cagr_historical(panel: DataFrame) -> DataFrame:
    """Entity CAGR from the first non-zero to the last period; NULL when
    fewer than 5 steps remain."""
    ep = trim_leading_zeros(entity_period(panel), keys=["entity"])
    g = ep.groupBy("entity").agg(F.min_by("value", "t").alias("v0"), F.max_by("value", "t").alias("v1"),
                                 (F.count("*") - 1).alias("steps"))
    return g.select("entity", F.when((F.col("steps") >= 5) & (F.col("v0") > 0),
                                     cagr(F.col("v1"), F.col("v0"), F.col("steps"))).alias("growth_historical"))


def share_change(panel: DataFrame, keys=SERIES) -> DataFrame:
    """Share (%) of each series in the first and the last period total."""
    last = panel.agg(F.max("t").alias("t_last"))
    x = panel.crossJoin(F.broadcast(last))
    v0 = F.when(F.col("t") == 0, F.col("value"))
    v1 = F.when(F.col("t") == F.col("t_last"), F.col("value"))
    g = x.groupBy(*keys).agg(F.max(v0).alias("v0"), F.max(v1).alias("v1"))
    tot = x.agg(dsum(v0).alias("tot0"), dsum(v1).alias("tot1"))
    return g.crossJoin(F.broadcast(tot)).select(
        *keys, (ratio("v0", "tot0") * 100).alias("share_first"),
        (ratio("v1", "tot1") * 100).alias("share_last")) \
        .withColumn("share_change", F.col("share_last") - F.col("share_first"))


def top_share_rest(panel: DataFrame, top: int = 8) -> DataFrame:
    """Share (%) by period of the ``top`` entities by mean share, plus
    'Rest' = 100 - their sum.  Ties broken by entity name."""
    sh = with_period_share(entity_period(panel)).withColumn("share", F.col("share") * 100)
    mean = sh.groupBy("entity").agg(F.avg("share").alias("mean_share"))
    rank = Window.orderBy(F.desc("mean_share"), "entity")          # entity grain
    tops = mean.withColumn("rk", F.row_number().over(rank)).filter(F.col("rk") <= top).select("entity")
    t_sh = sh.join(F.broadcast(tops), "entity", "left_semi")        # at most `top` rows
    rest = t_sh.groupBy("t").agg((100 - F.sum("share")).alias("share")).withColumn("entity", F.lit("Rest"))
    return t_sh.select("t", "entity", "share").unionByName(rest.select("t", "entity", "share"))


def regional_index(panel: DataFrame) -> DataFrame:
    """A3 + G9: region totals per period, indexed to the first period = 100,
    and each region's multiplier last/first."""
    rt = panel.groupBy("region", "t").agg(dsum("value").alias("total"))
    w = Window.partitionBy("region")
    base = F.min_by("total", "t").over(w)
    final = F.max_by("total", "t").over(w)
    return rt.withColumn("index_base100", ratio(F.col("total"), base) * 100) \
        .withColumn("multiplier", ratio(final, base))


def own_max_profile(panel: DataFrame, region_order: list[str] | None = None) -> DataFrame:
    """Entity-period values as % of the entity's own maximum, with the
    display order: region rank (given list, else region total desc), then
    entity mean desc."""
    ep = entity_period(panel)
    w = Window.partitionBy("entity")
    x = ep.withColumn("pct_of_max", ratio(F.col("value"), F.max("value").over(w)) * 100) \
        .withColumn("mean", F.avg("value").over(w))
    ent = x.select("entity", "region", "mean").distinct()
    if region_order:
        rr = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in region_order]), F.col("region")),
                        F.lit(99))
        ent = ent.withColumn("region_rank", rr.cast("int"))
    else:
        rtot = ent.groupBy("region").agg(F.sum("mean").alias("rt"))
        rtot = rtot.withColumn("region_rank", F.row_number().over(Window.orderBy(F.desc("rt"), "region")))
        ent = ent.join(rtot.select("region", "region_rank"), "region")
    ent = with_position(ent, ["region_rank", F.desc("mean"), "entity"]).withColumn("ord", F.col("pos").cast("int"))
    return x.join(ent.select("entity", "ord"), "entity").select("entity", "region", "t", "pct_of_max", "ord")


def category_mix(panel: DataFrame) -> DataFrame:
    """Category share (%) in the last vs the first period and delta."""
    last = panel.agg(F.max("t").alias("t_last"))
    x = panel.crossJoin(F.broadcast(last))
    g = x.groupBy("category").agg(dsum(F.when(F.col("t") == 0, F.col("value"))).alias("v0"),
                                  dsum(F.when(F.col("t") == F.col("t_last"), F.col("value"))).alias("v1"))
    w = Window.partitionBy()                                       # category grain
    return g.select("category", (ratio("v1", F.sum("v1").over(w)) * 100).alias("share_last"),
                    (ratio("v0", F.sum("v0").over(w)) * 100).alias("share_first")) \
        .withColumn("delta_pts", F.col("share_last") - F.col("share_first"))


def macro_kpis(panel: DataFrame) -> DataFrame:
    """First and last total, total growth %, CAGR %, last growth %."""
    mt = macro_trend(panel)
    g = mt.agg(F.min_by("total", "t").alias("first_total"), F.max_by("total", "t").alias("last_total"),
               (F.max("t") - F.min("t")).alias("steps"), F.max_by("yoy_pct", "t").alias("last_yoy_pct"))
    return g.select("first_total", "last_total",
                    ((ratio("last_total", "first_total") - 1) * 100).alias("total_growth_pct"),
                    cagr(F.col("last_total"), F.col("first_total"), F.col("steps")).alias("cagr_pct"),
                    "last_yoy_pct")
