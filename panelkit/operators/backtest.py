"""Holdout backtest and winner selection.

One fixed holdout of the last ``holdout`` points of each trimmed series
(series need ``min_history + holdout`` points).  The four models run on the
train part as grouped relations over the same partitioning (series key) and
are scored against the test rows by a join on (series, step).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import models as MD
from .metrics import trim_leading_zeros

HOLDOUT = 5          # fixed values of the reference
HORIZON = 5
MIN_HISTORY = 8


def indexed(panel: DataFrame, keys) -> DataFrame:
    """Trimmed series with i = 0..n-1 and n (T7/F6 shared by all stages)."""
    return trim_leading_zeros(panel, keys).withColumn("i", F.col("t") - F.col("t_first")) \
        .withColumnRenamed("n_obs", "n")


def from_heads(panel: DataFrame, heads: DataFrame, keys) -> DataFrame:
    """The rows of :func:`indexed` for the series of ``heads`` (keys, t_first,
    ...; one row per series): a join instead of windows over the panel."""
    return panel.join(heads, list(keys)).filter(F.col("t") >= F.col("t_first")) \
        .withColumn("i", F.col("t") - F.col("t_first"))


def split(panel: DataFrame, keys, holdout: int = HOLDOUT, min_history: int = MIN_HISTORY):
    """``(heads, train, test)``: one row per series with enough points, which is
    written once, and the rows before and in the holdout.  Trimming anew for
    every use would put a sort and a window of the panel into one task each time."""
    heads = cut_lineage(indexed(panel, keys).filter(F.col("n") >= min_history + holdout)
                        .groupBy(*keys).agg(F.min("t_first").alias("t_first"), F.max("n").alias("n")))
    s = from_heads(panel, heads, keys)
    train = s.filter(F.col("i") < F.col("n") - holdout)
    test = s.filter(F.col("i") >= F.col("n") - holdout) \
        .select(*keys, (F.col("i") - (F.col("n") - holdout) + 1).alias("step"), F.col("value").alias("actual"))
    return heads, train, test


def train_break_index(heads: DataFrame, breaks: DataFrame, keys, holdout: int = HOLDOUT) -> DataFrame:
    """Break index inside the train part, kept only if 0 < idx < len(train)-4."""
    j = heads.join(breaks.select(*keys, "breakpoint_t"), list(keys))
    idx = F.col("breakpoint_t") - F.col("t_first")
    ntrain = F.col("n") - holdout
    return j.filter(F.col("breakpoint_t").isNotNull() & (idx > 0) & (idx < ntrain - 4)) \
        .select(*keys, idx.cast("int").alias("bp_idx"))


def backtest_predictions(panel: DataFrame, breaks: DataFrame, keys, holdout: int = HOLDOUT,
                         models=MD.MODEL_ORDER) -> tuple[DataFrame, DataFrame]:
    heads, train, test = split(panel, keys, holdout)
    hist = train.select(*keys, "i", "value")
    parts = []
    closed = [m for m in ("naive_drift", "linear_trend", "segmented") if m in models]
    if closed:
        bp = train_break_index(heads, breaks, keys, holdout) if "segmented" in closed else None
        cf = MD.closed_form(hist, holdout, keys, bp)
        parts.append(cf.filter(F.col("model").isin(closed)))
    if "holt" in models:
        parts.append(MD.holt(hist, holdout, keys).withColumn("model", F.lit("holt")))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    return cut_lineage(pred), test          # series x models x holdout rows


def backtest_detail(panel: DataFrame, breaks: DataFrame, keys=("entity", "category"), holdout: int = HOLDOUT,
                    models=MD.MODEL_ORDER) -> DataFrame:
    """(series, model, step) -> prediction, actual and the last train
    period, one row per holdout point and model."""
    keys = list(keys)
    pred, test = backtest_predictions(panel, breaks, keys, holdout, models)
    seen = indexed(panel, keys).groupBy(*keys).agg((F.max("t") - holdout).cast("int").alias("train_last_t"))
    return pred.join(test, [*keys, "step"]).join(seen, keys).select(
        *keys, "model", "step", F.col("forecast").alias("prediction"), "actual", "train_last_t")


def train_breaks(panel: DataFrame, keys, holdout: int = HOLDOUT, **kw) -> DataFrame:
    """Breaks detected on the train part only (``breaks_on="train"``): the
    last ``holdout`` points of every trimmed series are removed first, so the
    backtest never sees its test years (the reference detects on the full
    series, a mild leakage; that stays the default)."""
    from .breaks import detect_breaks
    s = indexed(panel, keys)
    first = s.groupBy(*keys).agg(F.min("t_first").alias("_tf"), F.max("n").alias("_n"))
    cut = panel.join(first, list(keys)).filter(F.col("t") < F.col("_tf") + F.col("_n") - holdout) \
        .drop("_tf", "_n")
    return detect_breaks(cut, keys, **kw)


def backtest_scores(panel: DataFrame, breaks: DataFrame, keys=("entity", "category"),
                    models=MD.MODEL_ORDER, breaks_on: str = "full") -> DataFrame:
    """(series, model) -> mape, rmse.  ``breaks_on="train"`` re-detects the
    breaks without the holdout points."""
    keys = list(keys)
    if breaks_on == "train":
        breaks = train_breaks(panel, keys)
    pred, test = backtest_predictions(panel, breaks, keys, models=models)
    return MD.mape_rmse(pred, test, keys)


def best_model(scores: DataFrame, keys) -> DataFrame:
    """Lowest non-null MAPE, ties by the fixed model order; NULL if none."""
    order = F.array_position(F.array(*[F.lit(m) for m in MD.MODEL_ORDER]), F.col("model"))
    v = scores.filter(F.col("mape").isNotNull())
    pick = v.groupBy(*keys).agg(F.min_by(F.struct("model", "mape"), F.struct("mape", order)).alias("_b"))
    return pick.select(*keys, F.col("_b.model").alias("best_model"), F.col("_b.mape").alias("best_mape"))


def backtest_summary(panel: DataFrame, breaks: DataFrame, keys=("entity", "category")) -> DataFrame:
    """One row per backtested series: winner and MAPE per model."""
    keys = list(keys)
    sc = backtest_scores(panel, breaks, keys)
    wide = sc.groupBy(*keys).pivot("model", list(MD.MODEL_ORDER)).agg(F.first("mape"))
    for m in MD.MODEL_ORDER:
        wide = wide.withColumnRenamed(m, f"{m}_mape")
    return wide.join(best_model(sc, keys), keys, "left")


def segmented_vs_linear(summary: DataFrame, breaks: DataFrame, keys=("entity", "category")) -> DataFrame:
    """Series with a break and both MAPEs: improvement."""
    from .rules import improvement_flags
    keys = list(keys)
    with_break = summary.join(breaks.filter(F.col("breakpoint_t").isNotNull()).select(*keys), keys, "left_semi")
    comp = with_break.filter(F.col("segmented_mape").isNotNull() & F.col("linear_trend_mape").isNotNull())
    return comp.select(*keys, "linear_trend_mape", "segmented_mape",
                       *improvement_flags("segmented_mape", "linear_trend_mape"))


def improvement_summary(comp: DataFrame) -> DataFrame:
    """Counts and conditional means of the improvement."""
    return comp.agg(F.count("*").alias("n_compared"), F.count_if(F.col("improvement") > 0).alias("n_better"),
                    F.avg(F.when(F.col("improvement") > 0, F.col("improvement"))).alias("avg_gain"),
                    F.avg(F.when(F.col("improvement") < 0, F.col("improvement"))).alias("avg_loss"))
