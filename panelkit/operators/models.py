"""Forecast models over a long history table.

A history is ``(keys..., i, value)`` with ``i`` = 0..n-1 per series.  Every
model returns ``(keys..., step, forecast, lower_80, upper_80)`` for steps
1..h.  Closed-form models are grouped aggregates (one shuffle by series);
lines are fitted on ordered points, so results do not depend on partitioning.
Holt's fit has no closed form over (alpha, beta); it runs as an Arrow-batched
``mapInPandas`` over a series-array table, vectorised over series x grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ordered_points, with_line

Z80 = 1.28      # fixed value: the reference's 80% band multiplier
MODEL_ORDER = ("naive_drift", "linear_trend", "holt", "segmented")   # fixed tie order


def _steps(g: DataFrame, h: int) -> DataFrame:
    return g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))


def naive_drift(hist: DataFrame, h: int, keys) -> DataFrame:
    """y_n + step*(y_n - y_1)/(n-1)."""
    return _only(closed_form(hist, h, keys), "naive_drift")


def closed_form(hist: DataFrame, h: int, keys, bp: DataFrame | None = None, only_breaks: bool = True) -> DataFrame:
    """naive drift, linear trend and segmented linear in ONE grouped pass
    (T8, T9, T11, T12); every use of these models goes through here.

    One window (lag, for the differences) and one aggregation per series; the
    lines are fitted on the series' ordered points.  Bands: 1.28 * std_pop of
    the differences * sqrt(step) for the drift, 1.28 * std_pop of the residuals
    * sqrt(1 + 1/n) for the lines.  Output has a ``model`` column.

    ``bp`` (keys, bp_idx) drives the segmented model, OLS on the part from the
    break index on; without it that model is not produced.  The full series is
    used where the index is negative, > n-4 or leaves fewer than 4 points, and
    (with ``only_breaks=False``) where there is none.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("i")
    x = hist.withColumn("_d", F.col("value") - F.lag("value").over(w))
    g = x.groupBy(*keys).agg(
        F.min_by("value", "i").alias("_y1"), F.max_by("value", "i").alias("_yn"), F.count("*").alias("_n"),
        F.stddev_pop("_d").alias("_sdd"), ordered_points("i").alias("_pts"))
    if bp is not None:
        g = g.join(bp.select(*keys, "bp_idx"), keys, "left")
        idx = F.col("bp_idx")
        ok = idx.isNotNull() & (idx >= 0) & (idx <= F.col("_n") - 4)
        g = g.withColumn("_from", F.when(ok, idx).otherwise(F.lit(0)).cast("double"))
        g = g.withColumn("_post", F.transform(F.filter("_pts", lambda q: q["x"] >= F.col("_from")),
                                              lambda q: F.struct((q["x"] - F.col("_from")).alias("x"), q["y"].alias("y"))))
        g = with_line(g, "_post", "s")
    g = with_line(g, "_pts", "l")
    drift = F.when(F.col("_n") > 1, (F.col("_yn") - F.col("_y1")) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    step = F.col("step").cast("double")

    def band(model, fc, spread):
        return F.struct(F.lit(model).alias("model"), fc.alias("forecast"), (fc - spread).alias("lower_80"),
                        (fc + spread).alias("upper_80"))

    def line(model, p):
        n = F.col(f"{p}_n")
        return band(model, F.col(f"{p}_a") + F.col(f"{p}_b") * (n - 1 + step), Z80 * F.col(f"{p}_sd") * F.sqrt(1 + 1 / n))

    rows = [band("naive_drift", F.col("_yn") + step * drift, Z80 * F.col("_sdd") * F.sqrt(step)), line("linear_trend", "l")]
    if bp is not None:
        rows.append(line("segmented", "s"))
    out = _steps(g, h).withColumn("_m", F.explode(F.array(*rows)))
    if bp is not None and only_breaks:
        out = out.filter((F.col("_m.model") != "segmented") | F.col("bp_idx").isNotNull())
    return out.select(*keys, "step", "_m.model", "_m.forecast", "_m.lower_80", "_m.upper_80")


def _only(rows: DataFrame, model: str) -> DataFrame:
    return rows.filter(F.col("model") == model).drop("model")


def linear_trend(hist: DataFrame, h: int, keys) -> DataFrame:
    """OLS on 0..n-1."""
    return _only(closed_form(hist, h, keys), "linear_trend")


def segmented(hist: DataFrame, h: int, keys, bp: DataFrame) -> DataFrame:
    """OLS on the part from the break index on, for every series."""
    return _only(closed_form(hist, h, keys, bp, only_breaks=False), "segmented")


# ---------------------------------------------------------------- Holt
ALPHAS = np.round(np.arange(1, 21) * 0.05, 10)      # 0.05 .. 1.00
BETAS = np.round(np.arange(0, 21) * 0.05, 10)       # 0.00 .. 1.00
FINE = np.round(np.arange(-10, 11) * 0.005, 10)     # +-0.05 around the best cell


def _holt_sse(y: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Closed-form initial state for every (series, cell).

    y: (S, n); a, b: (S, G) smoothing parameters.  With the error-correction
    form e = y - (l + t); l' = l + t + a*e; t' = t + a*b*e, level and trend
    are affine in (l0, t0): carry their coefficients, accumulate the normal
    equations of SSE(l0, t0) and solve the 2x2 system.  Returns l0, t0, sse.
    """
    S, n = y.shape
    G = a.shape[1]
    # level = c0 + c1*l0 + c2*t0 ; trend = d0 + d1*l0 + d2*t0
    c0 = np.zeros((S, G)); c1 = np.ones((S, G)); c2 = np.zeros((S, G))
    d0 = np.zeros((S, G)); d1 = np.zeros((S, G)); d2 = np.ones((S, G))
    s11 = np.zeros((S, G)); s12 = np.zeros((S, G)); s22 = np.zeros((S, G))
    s01 = np.zeros((S, G)); s02 = np.zeros((S, G)); s00 = np.zeros((S, G))
    ab = a * b
    for k in range(n):
        yk = y[:, k:k + 1]
        g0 = yk - (c0 + d0)          # e = g0 - g1*l0 - g2*t0
        g1 = c1 + d1
        g2 = c2 + d2
        s00 += g0 * g0; s01 += g0 * g1; s02 += g0 * g2
        s11 += g1 * g1; s12 += g1 * g2; s22 += g2 * g2
        # state update: l' = l + t + a*e ; t' = t + a*b*e
        nc0 = c0 + d0 + a * g0; nc1 = c1 + d1 - a * g1; nc2 = c2 + d2 - a * g2
        d0 = d0 + ab * g0; d1 = d1 - ab * g1; d2 = d2 - ab * g2
        c0, c1, c2 = nc0, nc1, nc2
    det = s11 * s22 - s12 * s12
    with np.errstate(divide="ignore", invalid="ignore"):
        l0 = np.where(det != 0, (s01 * s22 - s02 * s12) / det, 0.0)
        t0 = np.where(det != 0, (s02 * s11 - s01 * s12) / det, 0.0)
    sse = s00 - 2 * l0 * s01 - 2 * t0 * s02 + l0 * l0 * s11 + 2 * l0 * t0 * s12 + t0 * t0 * s22
    return l0, t0, sse


def _argmin_cell(sse: np.ndarray) -> np.ndarray:
    """First minimum per row (cells are in (alpha, beta) order)."""
    s = np.where(np.isfinite(sse), sse, np.inf)
    return np.argmin(s, axis=1)


def holt_fit(y: np.ndarray):
    """Fit Holt's additive trend on equal-length series y (S, n).

    Grid 0.05 step over alpha in (0,1], beta in [0,1], then one 0.005 step
    refinement around the best cell.  Returns alpha, beta, final level,
    final trend and the one-step residuals (S, n).
    """
    S, n = y.shape
    A, B = np.meshgrid(ALPHAS, BETAS, indexing="ij")
    a = np.broadcast_to(A.ravel(), (S, A.size)); b = np.broadcast_to(B.ravel(), (S, B.size))
    _, _, sse = _holt_sse(y, a, b)
    best = _argmin_cell(sse)
    a0 = a[np.arange(S), best][:, None]; b0 = b[np.arange(S), best][:, None]
    fa, fb = np.meshgrid(FINE, FINE, indexing="ij")
    a2 = np.clip(a0 + fa.ravel()[None, :], 0.005, 1.0)
    b2 = np.clip(b0 + fb.ravel()[None, :], 0.0, 1.0)
    l0, t0, sse2 = _holt_sse(y, a2, b2)
    k = _argmin_cell(sse2)
    idx = np.arange(S)
    alpha, beta, lv, tr = a2[idx, k], b2[idx, k], l0[idx, k], t0[idx, k]
    resid = np.empty((S, n))
    for j in range(n):
        e = y[:, j] - (lv + tr)
        resid[:, j] = e
        lv, tr = lv + tr + alpha * e, tr + alpha * beta * e
    return alpha, beta, lv, tr, resid


HOLT_FIT_FIELDS = "alpha double, beta double, level double, trend double, sd double, n int"


def _holt_batches(keys):
    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            out = []
            lens = pdf["ys"].map(len)
            for n, grp in pdf.groupby(lens):
                y = np.vstack(grp["ys"].to_numpy()).astype(float)
                for lo in range(0, len(grp), 512):            # bounded memory per chunk
                    part = grp.iloc[lo:lo + 512]
                    alpha, beta, lv, tr, resid = holt_fit(y[lo:lo + 512])
                    res = part[list(keys)].reset_index(drop=True)
                    res["alpha"], res["beta"], res["level"], res["trend"] = alpha, beta, lv, tr
                    res["sd"] = resid.std(axis=1)
                    res["n"] = np.int32(n)
                    out.append(res)
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def _series_arrays(hist: DataFrame, keys) -> DataFrame:
    """One row per series with its values ordered by i (bounded by the
    series length, never by the number of series)."""
    arr = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("_p"))
    return arr.select(*keys, F.col("_p.value").alias("ys"))


def holt_params(hist: DataFrame, keys) -> DataFrame:
    """Fitted (alpha, beta, level, trend, sd, n) per series with n >= 4."""
    arr = _series_arrays(hist, keys).filter(F.size("ys") >= 4)
    # The fit is CPU-bound per series, not per byte: spread the series rows
    # (one per series, small) over all cores instead of letting AQE pack them
    # by size into a few partitions.
    arr = arr.repartition(*keys)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                           for f in arr.schema.fields if f.name in keys)
    return arr.mapInPandas(_holt_batches(keys), f"{key_schema}, {HOLT_FIT_FIELDS}")


def holt(hist: DataFrame, h: int, keys) -> DataFrame:
    """Holt forecast level + step*trend; band 1.28*std_pop(one-step
    residuals)*sqrt(step).  Series shorter than 4 points use naive drift."""
    g = holt_params(hist, keys)
    s = _steps(g, h)
    fc = F.col("level") + F.col("step") * F.col("trend")
    spread = Z80 * F.col("sd") * F.sqrt(F.col("step").cast("double"))
    out = s.select(*keys, "step", fc.alias("forecast"), (fc - spread).alias("lower_80"),
                   (fc + spread).alias("upper_80"))
    n = hist.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") < 4)
    fallback = naive_drift(hist.join(n, list(keys), "left_semi"), h, keys)
    return out.unionByName(fallback)


def mape_rmse(pred: DataFrame, actual: DataFrame, keys) -> DataFrame:
    """T13/T14 per (series, model): MAPE % over non-zero actuals (NULL if
    none) and RMSE over all test points."""
    j = pred.join(actual, [*keys, "step"])
    ape = F.when(F.col("actual") != 0, F.abs((F.col("actual") - F.col("forecast")) / F.col("actual")))
    return j.groupBy(*keys, "model").agg(
        (F.avg(ape) * 100).alias("mape"),
        F.sqrt(F.avg(F.pow(F.col("actual") - F.col("forecast"), 2))).alias("rmse"))
