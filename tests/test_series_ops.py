"""Hand-written series cases for breaks, models and the floor chain."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import backtest as BT
from panelkit.operators import breaks as BK
from panelkit.operators import forecast as FC
from panelkit.operators import models as MD


def _panel(spark, series: dict):
    rows = [(e, "c", "r", t, f"{t}", float(v)) for e, vals in series.items() for t, v in enumerate(vals)]
    return spark.createDataFrame(rows, "entity string, category string, region string, t int, "
                                       "period_label string, value double")


def brute_segmentation(y, pen=3.0, ms=5):
    """Exact optimum by enumeration of all admissible breakpoint sets
    (on the series after its leading zeros, as the operator sees it)."""
    y = np.asarray(y, float)
    y = y[int(np.argmax(y > 0)):]
    d = np.diff(y)
    m = len(d)
    best = None
    for k in range(0, m // ms):
        for bps in itertools.combinations(range(ms, m - ms + 1), k):
            cuts = [0, *bps, m]
            if any(b - a < ms for a, b in zip(cuts, cuts[1:])):
                continue
            cost = sum(((d[a:b] - d[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + pen * k
            if best is None or cost < best[0] - 1e-9:
                best = (cost, list(bps))
    return best[1]


def test_segmentation_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    series = {f"s{i}": list(np.round(np.cumsum(rng.normal(5, 20, 24)) + 500, 2)) for i in range(12)}
    series["kink"] = [float(x) for x in range(15)] + [14.0 + 10 * k for k in range(1, 10)]
    p = _panel(spark, series)
    tr = BT.indexed(p, ["entity", "category"])
    got = {r["entity"]: list(r["breakpoints"]) for r in
           BK.segment_series(tr, ["entity", "category"]).collect()}
    for name, vals in series.items():
        assert got[name] == brute_segmentation(vals), name


def test_break_rules(spark):
    series = {
        "flat": [7.0] * 12,                                   # zero variance -> none
        "kink": [float(x) for x in range(15)] + [14.0 + 10 * k for k in range(1, 10)],
        "short": [float(x) for x in range(1, 10)],            # 9 points -> none
        "late": [0.0] * 6 + [float(x * x) for x in range(1, 13)],
        "zero": [0.0] * 12,                                   # omitted
    }
    b = {r["entity"]: r for r in BK.detect_breaks(_panel(spark, series)).collect()}
    assert "zero" not in b
    assert b["flat"]["significance"] == "none" and b["flat"]["pre_slope"] == 0.0
    assert b["short"]["breakpoint_t"] is None and b["short"]["n_observations"] == 9
    assert b["kink"]["breakpoint_t"] is not None and b["kink"]["significance"] == "strong"
    assert b["late"]["n_observations"] == 12


def test_naive_and_linear(spark):
    hist = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 12, 14, 16, 18, 20, 22, 24])],
                                 "entity string, i int, value double")
    nv = {r["step"]: r for r in MD.naive_drift(hist, 3, ["entity"]).collect()}
    assert nv[1]["forecast"] == pytest.approx(26.0) and nv[3]["forecast"] == pytest.approx(30.0)
    assert nv[1]["lower_80"] == pytest.approx(26.0)           # constant diffs -> zero band
    ln = {r["step"]: r for r in MD.linear_trend(hist, 2, ["entity"]).collect()}
    assert ln[2]["forecast"] == pytest.approx(28.0)


def test_holt_closed_form_matches_least_squares():
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(2, 1, (3, 15)), axis=1) + 50
    a = np.full((3, 1), 0.4)
    b = np.full((3, 1), 0.2)
    l0, t0, sse = MD._holt_sse(y, a, b)

    def sse_of(l, t, yy):
        e_sum = 0.0
        for v in yy:
            e = v - (l + t)
            e_sum += e * e
            l, t = l + t + 0.4 * e, t + 0.4 * 0.2 * e
        return e_sum
    for s in range(3):
        # the closed form is the minimum: perturbing the state increases SSE
        base = sse_of(l0[s, 0], t0[s, 0], y[s])
        assert base == pytest.approx(sse[s, 0], rel=1e-6)
        for dl, dt in [(0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)]:
            assert sse_of(l0[s, 0] + dl, t0[s, 0] + dt, y[s]) > base


def test_floor_chain(spark):
    fc = spark.createDataFrame([("a", k, f, f - 5, f + 5) for k, f in zip(range(1, 6), [60.0, 50.0, 10.0, -5.0, 3.0])],
                               "entity string, step int, forecast double, lower_80 double, upper_80 double")
    last = spark.createDataFrame([("a", 100.0)], "entity string, last_value double")
    out = {r["step"]: r for r in FC.floor_chain(fc, last, ["entity"]).collect()}
    expect = [70.0, 50.0, 35.0, 24.5, 17.15]
    for k, e in enumerate(expect, 1):
        assert out[k]["forecast"] == pytest.approx(e)
        assert out[k]["forecast"] >= 0 and out[k]["lower_80"] <= out[k]["upper_80"]
    assert out[1]["lower_80"] == pytest.approx(63.0)          # max(55, 0.9 * 70)


def test_backtest_winner_order(spark):
    sc = spark.createDataFrame([("a", "naive_drift", 1.0), ("a", "linear_trend", 1.0), ("b", "holt", None),
                                ("c", "segmented", 0.5), ("c", "holt", 0.5)],
                               "entity string, model string, mape double")
    w = {r["entity"]: r["best_model"] for r in BT.best_model(sc, ["entity"]).collect()}
    assert w == {"a": "naive_drift", "c": "holt"}


def test_bic_penalty_and_train_breaks(spark):
    rng = np.random.default_rng(11)
    series = {f"s{i}": list(np.round(np.cumsum(rng.normal(5, 20, 24)) + 500, 2)) for i in range(6)}
    p = _panel(spark, series)
    tr = BT.indexed(p, ["entity", "category"])
    bic = {r["entity"]: list(r["breakpoints"]) for r in BK.segment_series(tr, ["entity", "category"], pen="bic").collect()}
    for name, vals in series.items():
        y = np.asarray(vals, float)
        pen = 2 * np.var(np.diff(y)) * np.log(len(y) - 1)
        assert bic[name] == brute_segmentation(vals, pen=pen), name
    tb = BT.train_breaks(p, ["entity", "category"]).collect()
    assert all(r["n_observations"] == 19 for r in tb)
    sc = BT.backtest_scores(p, None, ["entity", "category"], breaks_on="train")
    assert sc.count() >= 6 * 3


def test_one_task_of_the_forecast_holds_few_sorts(spark):
    """Each sort or window keeps pages of its own until its task ends, so trimming
    the panel for every use put well over a dozen of them into one task."""
    keys = ["entity", "category"]
    p = _panel(spark, {"a": list(range(1, 25)), "b": [0.0] * 3 + [float(x * x) for x in range(1, 22)], "few": [1.0] * 4})
    breaks = BK.detect_breaks(p)
    scores = BT.backtest_scores(p, breaks)
    ahead = FC.forecast_all(p, breaks, BT.best_model(scores, keys))
    for out in (scores, ahead):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Sort ") <= 6, plan
    assert {r["entity"]: r["count"] for r in ahead.groupBy("entity").count().collect()} == {"a": 5, "b": 5}


def test_lines_of_small_slopes_and_large_values(spark):
    rows = [("small", k, 0.001 * k) for k in range(30)]
    rows += [("large", k, 1e9 + 3.0 * k + (0.5 if k % 2 else -0.5)) for k in range(30)]
    rows += [("huge", k, 1e19 + 1e16 * k) for k in range(30)]
    hist = spark.createDataFrame(rows, "entity string, i int, value double")
    got = {(r["entity"], r["model"]): r for r in MD.closed_form(hist, 1, ["entity"]).collect()}
    assert got["small", "linear_trend"]["forecast"] == pytest.approx(0.03, rel=1e-9)
    large = got["large", "linear_trend"]
    # residuals of +-0.5 about the line: half a band is 1.28 * 0.5 * sqrt(1 + 1/30), near enough
    assert (large["upper_80"] - large["lower_80"]) / 2 == pytest.approx(0.65, abs=0.01)
    assert got["huge", "linear_trend"]["forecast"] == pytest.approx(1e19 + 30 * 1e16, rel=1e-9)
    one = MD.linear_trend(hist, 1, ["entity"]).filter("entity = 'large'").first()
    assert (one["lower_80"], one["upper_80"]) == (large["lower_80"], large["upper_80"])


def test_slopes_under_a_cent(spark):
    rows = [("s", "c", k, 0.001 * k + 1e-4) for k in range(30)]
    panel = spark.createDataFrame(rows, "entity string, category string, t int, value double")
    from panelkit.operators.metrics import series_trend
    r = series_trend(panel).first()
    assert r["slope"] == pytest.approx(0.001, rel=1e-9) and r["intercept"] == pytest.approx(1e-4, rel=1e-6)
    b = BK.detect_breaks(panel).first()
    assert b["pre_slope"] == pytest.approx(0.001, rel=1e-9) and b["breakpoint_t"] is None


def test_long_series_are_searched_in_seconds(spark):
    """3,000 points in one series, and the cut against slopes fitted one by one."""
    rng = np.random.default_rng(11)
    y = 5000 + np.cumsum(np.repeat(rng.normal(0, 6, 60), 50) + rng.normal(0, 2, 3000))
    panel = _panel(spark, {"long": [0.0] * 7 + list(y)})
    BK.detect_breaks(_panel(spark, {"warm": list(y[:40])})).collect()
    t0 = time.perf_counter()
    row = BK.detect_breaks(panel).first()
    assert time.perf_counter() - t0 < 5
    starts = BK.optimal_starts(y, BK.PELT_PENALTY, 5)
    assert starts == full_search(np.diff(y), BK.PELT_PENALTY, 5)
    best = None
    for b in starts:
        if 5 <= b <= len(y) - 6:
            pre = np.polyfit(np.arange(b + 1.0), y[:b + 1], 1)[0]
            post = np.polyfit(np.arange(len(y) - b - 1.0), y[b + 1:], 1)[0]
            change = abs((post - pre) / pre) * 100 if abs(pre) >= 1 else abs(post - pre)
            if best is None or change > best[1] * (1 + 1e-9):
                best = b, change, pre, post
    assert row["breakpoint_t"] == 7 + best[0] + 1 and row["n_observations"] == 3000
    assert np.allclose([row["slope_change_pct"], row["pre_slope"], row["post_slope"]], best[1:], rtol=1e-7)


def full_search(d, pen, ms):
    """Every start for every end, as vectors."""
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    cost, back = np.full(len(d) + 1, np.inf), np.zeros(len(d) + 1, int)
    cost[0] = -pen
    for t in range(ms, len(d) + 1):
        s = np.r_[0, np.arange(ms, t - ms + 1)]
        c = cost[s] + s2[t] - s2[s] - (s1[t] - s1[s]) ** 2 / (t - s) + pen
        cost[t], back[t] = c.min(), s[c.argmin()]
    cuts, t = [], len(d)
    while back[t]:
        t = int(back[t])
        cuts.insert(0, t)
    return cuts


def test_breaks_of_odd_series(spark):
    """Keys of other types, null keys, an empty panel, and gaps in nothing else."""
    rows = [(k, t, float(v)) for k in (None, 3) for t, v in enumerate([0, 0] + list(range(1, 16)) + [15 + 10 * i for i in range(1, 9)])]
    panel = spark.createDataFrame(rows, "k long, t int, value double")
    got = {r["k"]: r for r in BK.detect_breaks(panel, ["k"]).collect()}
    assert set(got) == {None, 3} and all(r["significance"] == "strong" for r in got.values())
    assert BK.detect_breaks(panel.limit(0), ["k"]).count() == 0
