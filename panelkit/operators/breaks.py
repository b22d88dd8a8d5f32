"""Structural breaks per series.

1. Trim leading zeros; series with < 10 points or zero variance get the
   no-break row (T6).
2. Optimal partition of the first differences with an L2 (mean-shift) cost,
   minimum segment 5, penalty ``pen`` per segment (T3).  Exact dynamic
   programme F(t) = min_s F(s) + C(s,t) + pen, F(0) = -pen, lowest s on ties,
   where starts that can't win any more are dropped.
3. Each internal breakpoint b with 5 <= b <= m-5 is scored by the OLS slopes
   of values[0..b] and values[b+1..] (T4/T5); the strict maximum change wins
   (earliest b on ties) and must reach 30.

A series is one row with one array of points (one shuffle by series, after
which nothing moves).  The search is sequential within a series, so it runs in
an Arrow step over these rows: per series a few arrays as long as the series
(costs, back-pointers, prefix sums), one vector operation over the open starts
for each end, and every cut is scored from prefix sums.  Sums for the slopes
are taken about the series' means in extended precision, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import break_significance

MIN_SEGMENT = 5          # fixed values of the reference
SLOPE_THRESHOLD = 30.0
PELT_PENALTY = 3.0
MARGIN = 1e-9            # of the sum of squares: more than rounding can make up


def optimal_starts(values: np.ndarray, pen: float | str, ms: int) -> list[int]:
    """T3 for one series: starts of the segments of its differences after the
    first one, ascending.

    ``pen`` is the penalty per segment, or "bic": 2 * var(d) * ln(m), m the
    number of differences d.  A start whose segment up to t costs more than
    F(t) can't win for any end at which t may be a start itself (t + ms on), so
    it is dropped from there on; the margin covers the rounding of the sums.
    """
    y = np.asarray(values, np.float64)
    d = np.diff(y)
    m = len(d)
    if m < ms:
        return []
    if pen == "bic":
        pen = 2.0 * float(d.var()) * float(np.log(max(m, 2)))
    p1 = y - y[0]
    p2 = np.concatenate([[0.0], np.cumsum(d * d)])
    cost = np.full(m + 1, np.inf)
    cost[0] = -pen
    back = np.zeros(m + 1, np.int64)
    until = np.full(m + 1, m + 1, np.int64)         # the first end a start is ruled out for
    starts = np.zeros(1, np.int64)
    for t in range(ms, m + 1):
        usable = starts[:np.searchsorted(starts, t - ms, "right")]
        gap = p1[t] - p1[usable]
        total = cost[usable] + (p2[t] - p2[usable]) - gap * gap / (t - usable)
        best = int(np.argmin(total))
        cost[t], back[t] = total[best] + pen, usable[best]
        beaten = usable[total > cost[t] + MARGIN * (1 + abs(p2[t]))]
        until[beaten] = np.minimum(until[beaten], t + ms)
        starts = np.append(starts[until[starts] > t + 1], t)
    path, at = [], m
    while (at := int(back[at])) > 0:
        path.append(at)
    return path[::-1]


class Slopes:
    """OLS slopes of the first and the last points of a series, from prefix
    sums about the means."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x, y = np.asarray(x, np.longdouble), np.asarray(y, np.longdouble)
        x, y = x - x.mean(), y - y.mean()
        self.sums = [np.concatenate([[0], np.cumsum(v)]) for v in (x, y, x * x, x * y)]

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slope of the points low..high-1; 0 for fewer than two."""
        n = np.maximum(high - low, 1).astype(np.longdouble)
        sx, sy, sxx, sxy = (s[high] - s[low] for s in self.sums)
        below, above = sxx - sx * sx / n, sxy - sx * sy / n
        flat = (n < 2) | (below <= 0)
        return np.where(flat, 0.0, above / np.where(flat, 1, below)).astype(np.float64)


def best_cut(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, threshold: float) -> tuple | None:
    """T4/T5: the cut of the largest change of slope, (b, pre, post, change)."""
    if not len(cuts):
        return None
    lines = Slopes(x, y)
    zero, end = np.zeros(len(cuts), np.int64), np.full(len(cuts), len(y))
    pre, post = lines.between(zero, cuts + 1), lines.between(cuts + 1, end)
    steep = np.abs(pre) >= 1
    change = np.where(steep, np.abs((post - pre) / np.where(steep, pre, 1)) * 100, np.abs(post - pre))
    i = int(np.argmax(change))
    return (int(cuts[i]), float(pre[i]), float(post[i]), float(change[i])) if change[i] >= max(threshold, 1e-300) else None


def _series(rows: DataFrame, keys: list[str], x: str, extra=()) -> DataFrame:
    """One row per series: its points in the order of ``x``."""
    points = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("value").cast("double").alias("y"))))
    return rows.groupBy(*keys).agg(points.alias("_p"), *extra).select(
        *keys, F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))


def _map_series(series: DataFrame, keys: list[str], fields: list[tuple[str, T.DataType, pa.DataType]], one) -> DataFrame:
    """``one(x, y)`` for every series: a row of ``fields`` or None to drop it."""
    schema = T.StructType([series.schema[k] for k in keys] + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            xs, ys = (rb.column(rb.schema.get_field_index(c)) for c in ("_x", "_y"))
            got = [one(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False))
                   for x, y in zip(xs, ys)]
            kept = pa.array([g is not None for g in got], pa.bool_())
            columns = list(zip(*(g for g in got if g is not None))) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [rb.column(rb.schema.get_field_index(k)).filter(kept) for k in keys]
                + [pa.array(c, t) for c, (_, _, t) in zip(columns, fields)], names=keys + [n for n, _, _ in fields])

    return series.mapInArrow(run, schema)


_STARTS = ("breakpoints", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
_INT = T.IntegerType(), pa.int32()
_DOUBLE = T.DoubleType(), pa.float64()


def segment_series(trimmed: DataFrame, keys, pen=PELT_PENALTY, ms: int = MIN_SEGMENT) -> DataFrame:
    """Optimal breakpoints (indices into the differences) per series, as
    ``keys..., n, m, breakpoints``.  ``trimmed`` carries i (0..n-1) and value;
    ``pen`` as in :func:`optimal_starts`."""
    fields = [("n", *_INT), ("m", *_INT), _STARTS]
    return _map_series(_series(trimmed, list(keys), "i"), list(keys), fields,
                       lambda x, y: (len(y), len(y) - 1, optimal_starts(y, pen, ms)))


def detect_breaks(panel: DataFrame, keys=("entity", "category"), pen=PELT_PENALTY,
                  ms: int = MIN_SEGMENT, threshold: float = SLOPE_THRESHOLD) -> DataFrame:
    """One row per series that has a value above 0."""
    keys = list(keys)

    def search(x, y):
        above = np.flatnonzero(y > 0)
        if not len(above):
            return None
        x, y = x[above[0]:], y[above[0]:]
        found, n, t0 = None, len(y), int(x[0])
        if n >= 2 * ms and y.min() != y.max():
            cuts = np.array([b for b in optimal_starts(y, pen, ms) if ms <= b <= n - 1 - ms], np.int64)
            found = best_cut(x, y, cuts, threshold)
        if found is None:
            full = float(Slopes(x, y).between(np.array([0]), np.array([n]))[0])
            return None, full, full, 0.0, n
        b, pre, post, change = found
        return t0 + b + 1, pre, post, change, n

    fields = [("breakpoint_t", *_INT), ("pre_slope", *_DOUBLE), ("post_slope", *_DOUBLE),
              ("slope_change_pct", *_DOUBLE), ("n_observations", *_INT)]
    out = _map_series(_series(panel, keys, "t"), keys, fields, search)
    named = F.when(F.col("breakpoint_t").isNotNull(), break_significance("pre_slope", "post_slope", "slope_change_pct"))
    return out.select(*keys, "breakpoint_t", "pre_slope", "post_slope", "slope_change_pct",
                      F.coalesce(named, F.lit("none")).alias("significance"), "n_observations")
