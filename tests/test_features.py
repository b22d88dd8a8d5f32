"""The feature table against its parts, with entities that lack some of them."""

import math

from panelkit.operators import features as FT
from panelkit.operators import metrics as M


def _tables(spark):
    rng = range(12)
    values = {("a", "x"): [0, 0] + [10 + 3 * t for t in range(10)], ("a", "y"): [5] * 12, ("b", "x"): [0] * 12,
              ("c", "x"): [0] * 8 + [1, 2, 3, 4], ("d", "x"): [100 - t for t in rng], ("d", "z"): [t * t for t in rng]}
    panel = spark.createDataFrame([(e, "r" + e, c, t, str(t), float(v)) for (e, c), vs in values.items() for t, v in enumerate(vs)],
                                  "entity string, region string, category string, t int, period_label string, value double")
    breaks = spark.createDataFrame([("a", "x", 4), ("a", "y", None), ("d", "x", None)], "entity string, category string, breakpoint_t int")
    summary = spark.createDataFrame([("a", "x", 12.0), ("a", "y", None), ("b", "x", 3.0), ("d", "x", 250.0), ("d", "z", 7.0)],
                                    "entity string, category string, best_mape double")
    forecasts = spark.createDataFrame([("a", "x", 16, 70.0), ("a", "y", 16, 6.0), ("a", "x", 15, 1.0), ("b", "x", 16, 5.0),
                                       ("zz", "x", 16, 9.0)], "entity string, category string, t int, forecast double")
    return panel, breaks, summary, forecasts


def test_table_equals_its_parts(spark):
    panel, breaks, summary, forecasts = _tables(spark)
    got = {r["entity"]: r.asDict() for r in FT.entity_features(panel, breaks, summary, forecasts).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    parts = [M.entity_stats(panel).select("entity", "mean", "cv", "size_log"), M.cagr_historical(panel),
             FT.growth_forecast(panel, forecasts), FT.predictability(panel, summary), FT.had_breakpoint(breaks), FT.share_now(panel)]
    for part in parts:
        rows = {r["entity"]: r.asDict() for r in part.collect()}
        for column in part.columns[1:]:
            for e, row in got.items():
                want = rows.get(e, {}).get(column)
                assert (want is None) == (row[column] is None), (e, column)
                assert want is None or math.isclose(row[column], want, rel_tol=1e-12, abs_tol=1e-12), (e, column)
    assert [got[e]["region"] for e in "abcd"] == ["ra", "rb", "rc", "rd"]
    assert got["a"]["acceleration"] == got["a"]["growth_forecast"] - got["a"]["growth_historical"]


def test_the_panel_is_read_once(spark, tmp_path):
    panel, breaks, summary, forecasts = _tables(spark)
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for rb in batches:
            calls.add(rb.num_rows)
            yield rb

    counted = panel.mapInArrow(seen, panel.schema)
    FT.entity_features(counted, breaks, summary, forecasts).collect()
    assert calls.value == panel.count()
