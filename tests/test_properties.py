"""Property checks on the driver's smallest tables
and on batches of random series evaluated in one Spark job each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from panelkit.operators import backtest as BT
from panelkit.operators import metrics as M
from panelkit.operators import reshape as R
from panelkit.plans.panels import panel_a

SF = "/root/testdata/sf0.001"


def test_unpivot_of_pivot_is_identity(spark):
    p = panel_a(spark, SF)
    back = R.to_long(R.to_wide(p).drop("total")).select("entity", "category", "period_label", "value")
    assert back.exceptAll(p.select("entity", "category", "period_label", "value")).count() == 0
    assert p.select("entity", "category", "period_label", "value").exceptAll(back).count() == 0


def test_shares_sum_to_100_and_hhi_bounds(spark):
    p = panel_a(spark, SF)
    sums = M.top_share_rest(p).groupBy("t").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-6 for r in sums)
    for r in M.hhi(p).collect():
        assert 10000 / r["n_entities"] - 1e-6 <= r["hhi"] <= 10000 + 1e-6


def test_forecast_invariants_on_random_series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(200):
        n = int(rng.integers(8, 30))
        level = rng.uniform(10, 1000)
        trend = rng.normal(0, level / 10)
        y = np.maximum(0, level + trend * np.arange(n) + rng.normal(0, level / 5, n))
        if s % 7 == 0:
            y[-3:] = y[-3:] * 0.05                      # collapse at the end: floor chain binds
        rows += [(f"s{s}", "c", "r", t, str(t), float(round(v, 2))) for t, v in enumerate(y)]
    p = spark.createDataFrame(rows, "entity string, category string, region string, t int, "
                                    "period_label string, value double")
    keys = ["entity", "category"]
    from panelkit.plans.stages import Stages
    st = Stages(spark, SF, panel_fn=lambda *_: p)          # checkpointed stage chain
    fc = st.forecasts
    last = BT.indexed(st.panel, keys).groupBy(*keys).agg(F.max_by("value", "t").alias("last"),
                                                         F.max("t").alias("tl"), F.max("n").alias("n"))
    chk = fc.join(last, keys).withColumn("h", F.col("t") - F.col("tl"))
    bad = chk.filter((F.col("forecast") < 0) | (F.col("lower_80") > F.col("upper_80"))
                     | (F.col("forecast") < F.pow(F.lit(0.7), F.col("h")) * F.col("last") * (1 - 1e-9))
                     | (F.col("lower_80") > F.col("forecast") + 1e-6) | (F.col("upper_80") < F.col("forecast") - 1e-6))
    assert bad.count() == 0
    assert fc.select(*keys).distinct().count() == last.filter(F.col("n") >= 8).count()


@pytest.mark.parametrize("name", ["entry"])
def test_entry_schema_is_stable(spark, name):
    a = E.entry(spark).schema
    b = E.entry(spark).schema
    assert a == b
