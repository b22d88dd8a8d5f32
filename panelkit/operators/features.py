"""Entity features, winsorising and robust scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cagr, clip, dsum, ratio
from ..session import cut_lineage
from . import metrics as M
from .ranges import quantiles

CLUSTER_FEATURES = ["growth_forecast", "acceleration", "cv", "predictability"]   # fixed (reference)
HORIZON = 5


def growth_forecast(panel: DataFrame, forecasts: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Entity CAGR from the last actual period to ``horizon`` periods on:
    (forecast sum / actual sum)^(1/h) - 1, in %; entities need both."""
    last = panel.agg(F.max("t").alias("t_last"))
    act = panel.join(F.broadcast(last), panel.t == last.t_last).groupBy("entity") \
        .agg(dsum("value").alias("actual_last"), F.first("t_last").alias("t_last"))
    fc = forecasts.groupBy("entity", "t").agg(F.sum("forecast").alias("forecast_h"))
    j = act.join(fc, (act.entity == fc.entity) & (fc.t == act.t_last + horizon)).select(act.entity, "actual_last",
                                                                                       "forecast_h")
    return j.select("entity", cagr(F.col("forecast_h"), F.col("actual_last"), horizon).alias("growth_forecast"))


def predictability(panel: DataFrame, summary: DataFrame) -> DataFrame:
    """A9 + M2: 100 - MAPE weighted by series mean, clipped to 0..100.

    A NULL MAPE counts in the weights only; an entity whose MAPEs are all
    NULL has numerator 0 (pandas sum of NaN), and weight sum <= 0 -> NULL."""
    wm = M.wide_metrics(panel).select("entity", "category", "mean_value")
    j = summary.select("entity", "category", "best_mape").join(wm, ["entity", "category"], "left")
    g = j.groupBy("entity").agg(F.coalesce(F.sum(F.col("best_mape") * F.col("mean_value")), F.lit(0.0)).alias("num"),
                                F.sum("mean_value").alias("den"))
    wmape = F.when(F.col("den") > 0, F.col("num") / F.col("den"))
    return g.select("entity", clip(100 - wmape, 0.0, 100.0).alias("predictability"))


def had_breakpoint(breaks: DataFrame) -> DataFrame:
    """A10: 1 if any series of the entity has a break."""
    return breaks.groupBy("entity").agg(F.max(F.col("breakpoint_t").isNotNull().cast("int")).alias("had_breakpoint"))


def share_now(panel: DataFrame) -> DataFrame:
    """Entity share (%) of the last-period total."""
    last = panel.agg(F.max("t").alias("t"))
    lp = panel.join(F.broadcast(last), "t").groupBy("entity").agg(dsum("value").alias("v"))
    tot = lp.agg(F.sum("v").alias("tot"))                                # one row
    return lp.crossJoin(F.broadcast(tot)).select("entity", (ratio("v", "tot") * 100).alias("share_global_pct"))


def entity_features(panel: DataFrame, breaks: DataFrame, summary: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The entity feature table.

    The panel is read once, for sums by period and means by series (two grouping
    sets of one aggregate).  An entity's periods become one ordered array, at
    most as long as the period span, and all its history features come from that
    array; what breaks, backtest and forecasts add per entity is brought to the
    same key by one union and one aggregate instead of a join each.
    """
    key = ["entity", "region"]
    sums = cut_lineage(panel.groupingSets([[*key, "t"], [*key, "category"]], *key, "t", "category").agg(
        dsum("value").alias("value"), F.avg("value").alias("mean_value"), F.grouping("t").alias("_series")))
    points = sums.filter("_series = 0").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_p"))
    now = sums.filter("_series = 0").groupBy("t").agg(dsum("value").alias("_total")) \
        .agg(F.max(F.struct("t", "_total")).alias("_now")).select("_now.t", "_now._total")          # one row
    history = _history(points.crossJoin(F.broadcast(now.withColumnRenamed("t", "_t"))))
    ahead = forecasts.crossJoin(F.broadcast(now)).filter(forecasts.t == now.t + HORIZON) \
        .select("entity", F.col("forecast").alias("_forecast"))
    series = sums.filter("_series = 1").select("entity", "category", "mean_value")
    weighed = summary.select("entity", "category", "best_mape").join(series, ["entity", "category"], "left") \
        .select("entity", (F.col("best_mape") * F.col("mean_value")).alias("_miss"), F.col("mean_value").alias("_weight"),
                F.lit(True).alias("_scored"))
    broken = breaks.select("entity", F.col("breakpoint_t").isNotNull().cast("int").alias("had_breakpoint"))
    rows = history.unionByName(ahead, allowMissingColumns=True).unionByName(weighed, allowMissingColumns=True) \
        .unionByName(broken, allowMissingColumns=True)
    kept = ["mean", "cv", "size_log", "growth_historical", "_last", "share_global_pct"]
    one = rows.groupBy("entity").agg(
        F.max(F.struct("_here", "region", *kept)).alias("h"), F.sum("_forecast").alias("_forecast"),
        F.sum("_miss").alias("_miss"), F.sum("_weight").alias("_weight"), F.max("_scored").alias("_scored"),
        F.max("had_breakpoint").alias("had_breakpoint")).filter("h._here") \
        .select("entity", "h.region", *[f"h.{c}" for c in kept], "_forecast", "_miss", "_weight", "_scored", "had_breakpoint")
    off = F.when(F.col("_weight") > 0, F.coalesce("_miss", F.lit(0.0)) / F.col("_weight"))
    one = one.withColumns({"growth_forecast": cagr(F.col("_forecast"), F.col("_last"), HORIZON),
                           "predictability": F.when(F.col("_scored"), clip(100 - off, 0.0, 100.0))})
    return one.select("entity", "mean", "cv", "size_log", "growth_historical", "growth_forecast", "predictability",
                      "had_breakpoint", "share_global_pct", "region",
                      (F.col("growth_forecast") - F.col("growth_historical")).alias("acceleration"))


def _history(points: DataFrame) -> DataFrame:
    """Features of an entity's periods ``_p`` (array of (t, value) in order),
    beside the last period ``_t`` of all and its total."""
    def total(term):
        return F.aggregate("_p", F.lit(0.0), lambda acc, q: acc + term(q["value"]))

    n = F.size("_p")
    x = points.withColumn("mean", total(lambda v: v) / n)
    mean = F.col("mean")
    x = x.withColumn("_std", F.when(n > 1, F.sqrt(total(lambda v: (v - mean) * (v - mean)) / (n - 1))))
    x = x.withColumn("_live", F.get(F.filter("_p", lambda q: q["value"] > 0), F.lit(0))["t"])
    x = x.withColumn("_from", F.filter("_p", lambda q: q["t"] >= F.col("_live")))
    x = x.withColumn("_last", F.get(F.filter("_p", lambda q: q["t"] == F.col("_t")), F.lit(0))["value"])
    steps = F.size("_from") - 1
    grown = cagr(F.element_at("_p", -1)["value"], F.get("_from", F.lit(0))["value"], steps)
    return x.select("entity", "region", F.lit(True).alias("_here"), "mean", ratio(F.col("_std"), mean).alias("cv"),
                    F.log10(F.greatest(mean, F.lit(1.0))).alias("size_log"),
                    F.when(F.col("_live").isNotNull() & (steps >= 5), grown).alias("growth_historical"), "_last",
                    (ratio("_last", "_total") * 100).alias("share_global_pct"))


def percentile_bounds(df: DataFrame, cols, probs) -> DataFrame:
    """Exact (interpolated) percentiles of several columns, one row."""
    return quantiles(df, cols, probs)


def winsorize(df: DataFrame, cols=CLUSTER_FEATURES, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """M3: clip every column to its own [p5, p95]."""
    q = percentile_bounds(df, cols, [lo, hi])
    x = df.crossJoin(F.broadcast(q))                                      # one row
    for c in cols:
        x = x.withColumn(c, F.when(F.col(c).isNotNull(),
                                   F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1])))
    return x.drop(*[f"_q_{c}" for c in cols])


def robust_params(df: DataFrame, cols=CLUSTER_FEATURES) -> DataFrame:
    """median and IQR (zero IQR -> 1) per column, one row."""
    q = percentile_bounds(df, cols, [0.25, 0.5, 0.75])
    out = []
    for c in cols:
        iqr = F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
        out += [F.col(f"_q_{c}")[1].alias(f"med_{c}"), F.when(iqr == 0, 1.0).otherwise(iqr).alias(f"iqr_{c}")]
    return q.select(*out)


def robust_scale(df: DataFrame, cols=CLUSTER_FEATURES) -> tuple[DataFrame, DataFrame]:
    """M4: (x - median) / IQR; returns (scaled frame, parameters row)."""
    p = robust_params(df, cols)
    x = df.crossJoin(F.broadcast(p))
    for c in cols:
        x = x.withColumn(f"z_{c}", (F.col(c) - F.col(f"med_{c}")) / F.col(f"iqr_{c}"))
    return x.drop(*[f"med_{c}" for c in cols], *[f"iqr_{c}" for c in cols]), p
