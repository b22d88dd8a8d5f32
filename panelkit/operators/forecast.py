"""Final forecast with the backtest winner, floor chain and bands
(T18, T19, T21, T22, G14, G15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import models as MD
from .backtest import HORIZON, MIN_HISTORY, from_heads, indexed

FLOOR_RATIO = 0.70      # fixed values of the reference
LOW_FLOOR = 0.9
HIGH_FLOOR = 1.1


def floor_chain(fc: DataFrame, last: DataFrame, keys) -> DataFrame:
    """Step k may not fall below 70% of the previous (already floored)
    point, starting at the last actual; a floored step lifts its band to at
    least 0.9/1.1 x floor.  Then everything is clipped at 0.

    The chain is sequential, so it runs as an ``aggregate`` fold over the
    series' ``h`` points (bounded by the horizon)."""
    pts = fc.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("step", "forecast", "lower_80", "upper_80"))).alias("pts"))
    x = pts.join(last, list(keys))
    fold = F.aggregate(
        "pts",
        F.struct(F.col("last_value").alias("prev"),
                 F.array().cast("array<struct<step:int,forecast:double,lower_80:double,upper_80:double>>")
                 .alias("out")),
        lambda acc, p: F.struct(
            F.when(p["forecast"] < acc["prev"] * FLOOR_RATIO, acc["prev"] * FLOOR_RATIO)
            .otherwise(p["forecast"]).alias("prev"),
            F.concat(acc["out"], F.array(F.when(
                p["forecast"] < acc["prev"] * FLOOR_RATIO,
                F.struct(p["step"].alias("step"), (acc["prev"] * FLOOR_RATIO).alias("forecast"),
                         F.greatest(p["lower_80"], acc["prev"] * FLOOR_RATIO * LOW_FLOOR).alias("lower_80"),
                         F.greatest(p["upper_80"], acc["prev"] * FLOOR_RATIO * HIGH_FLOOR).alias("upper_80")))
                .otherwise(p))).alias("out")))
    out = x.select(*keys, F.inline_outer(fold["out"])).filter(F.col("step").isNotNull())
    z = F.lit(0.0)
    return out.select(*keys, "step", F.greatest("forecast", z).alias("forecast"),
                      F.greatest("lower_80", z).alias("lower_80"), F.greatest("upper_80", z).alias("upper_80"))


def forecast_all(panel: DataFrame, breaks: DataFrame, summary: DataFrame, keys=("entity", "category"),
                 horizon: int = HORIZON, models=MD.MODEL_ORDER, apply_floor: bool = True) -> DataFrame:
    """Winner (default naive drift) on the full trimmed series (>= 8
    points), horizon steps; ``t`` continues the period index."""
    keys = list(keys)
    s = indexed(panel, keys).filter(F.col("n") >= MIN_HISTORY)
    info = s.groupBy(*keys).agg(F.max("t").alias("t_last"), F.max_by("value", "t").alias("last_value"),
                                F.min("t_first").alias("t_first"), F.max("n").alias("n"))
    win = summary.select(*keys, "best_model") if "best_model" in summary.columns else summary
    info = info.join(win, keys, "left").withColumn(
        "model_used", F.coalesce(F.col("best_model"), F.lit("naive_drift")))
    if "holt" not in models:
        info = info.withColumn("model_used", F.when(F.col("model_used") == "holt", "naive_drift")
                               .otherwise(F.col("model_used")))
    info = info.join(breaks.select(*keys, "breakpoint_t"), keys, "left") \
        .withColumn("bp_idx", (F.col("breakpoint_t") - F.col("t_first")).cast("int"))
    # One row per series, written once: every step below joins it, where a lazy
    # frame would trim the panel anew by windows, all in the same task.
    info = cut_lineage(info)
    hist = from_heads(panel, info.select(*keys, "t_first", "model_used"), keys).select(*keys, "i", "value", "model_used")

    closed = info.filter(F.col("model_used") != "holt").select(*keys, "model_used")
    cf = MD.closed_form(hist.filter(F.col("model_used") != "holt").select(*keys, "i", "value"), horizon, keys,
                        info.select(*keys, "bp_idx"))
    fc = cf.join(closed, keys).filter(F.col("model") == F.col("model_used")) \
        .select(*keys, "step", "forecast", "lower_80", "upper_80")
    if "holt" in models:
        fc = fc.unionByName(MD.holt(hist.filter(F.col("model_used") == "holt").select(*keys, "i", "value"), horizon, keys))
    fc = cut_lineage(fc)                    # series x horizon rows
    if apply_floor:
        fc = floor_chain(fc, info.select(*keys, "last_value"), keys)
    return fc.join(info, keys).select(
        *keys, (F.col("t_last") + F.col("step")).cast("int").alias("t"), "forecast", "lower_80", "upper_80",
        "model_used", F.col("bp_idx").isNotNull().alias("had_breakpoint"))
