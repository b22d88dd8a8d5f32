"""Positions, ranks and quantiles over range partitions, against plain Python."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import ranges
from panelkit.operators.ranges import quantiles, with_average_rank, with_position
from panelkit.operators.score import sensitivity


def test_positions_and_sums_per_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {(r["k"], r["id"]): (r["pos"], r["before"])
           for r in with_position(df, [F.desc("v"), "id"], ["k"], "v").collect()}
    for k in "ab":
        before = 0
        for pos, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            assert got[k, i] == (pos, before)
            before += v


def test_average_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None), (5, None), (6, 1.0)], "id int, v double")
    ranked = with_average_rank(with_position(df, [F.desc_nulls_last("v"), "id"]), "v")
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {3: 1.0, 1: 2.5, 2: 2.5, 6: 4.0, 4: 5.5, 5: 5.5}


def test_quantiles_equal_the_built_in(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1.0, 1.0, rng.gauss(0, 1e6)]), float(rng.randrange(5)), None) for _ in range(301)]
    df = spark.createDataFrame(rows, "a double, b double, empty double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles(df, ["a", "b", "empty"], probs).first()
    want = df.agg(F.percentile("a", probs).alias("a"), F.percentile("b", probs).alias("b")).first()
    for c in "ab":
        assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) for x, y in zip(got[f"_q_{c}"], want[c]))
    assert got["_q_empty"] == [None] * len(probs)


@pytest.mark.parametrize("accuracy", [12, 100])
def test_quantiles_from_coarse_sketches(spark, monkeypatch, accuracy):
    """Many rounds: values over all magnitudes, ties, NaN, infinities."""
    monkeypatch.setattr(ranges, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [(math.ldexp(rng.random(), rng.randint(-300, 300)) * rng.choice([-1, 1]), float(rng.choice([7, 7, 7, 8])),
             rng.choice([float("inf"), -3.0, 0.0, float("nan")])) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = quantiles(df, ["a", "b", "c"], probs).first()
    for i, c in enumerate("abc"):
        vs = sorted(r[i] for r in rows if not math.isnan(r[i]))
        for j, p in enumerate(probs):
            at = p * (len(vs) - 1)
            lo, hi, f = vs[math.floor(at)], vs[math.ceil(at)], at - math.floor(at)
            assert got[f"_q_{c}"][j] == (lo if f == 0 else lo * (1 - f) + hi * f)


def test_quantiles_neither_sort_nor_copy(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    quantiles(spark.range(1000).select(F.col("id").cast("double").alias("v")), ["v"], [0.25, 0.5]).first()
    assert not any(files for _, _, files in os.walk(tmp_path))


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert with_position(df, ["v"], ["k"], "v").count() == 0
    assert quantiles(df, ["v"], [0.5]).first()["_q_v"] == [None]


def test_sensitivity_has_no_window_keyed_by_scenario(spark):
    rows = [(f"e{i}", float(i % 7), float(i % 5), float(i % 3), float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, size_log double, growth_forecast double, acceleration double, "
                                     "predictability double")
    res = sensitivity(df)
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window") and "ips" in line]
    assert windows and all("_part" in line for line in windows)
    assert res.count() == 16 and res.agg(F.max("spearman_rho")).first()[0] <= 1.0


@pytest.mark.parametrize("names", [["a"], ["a", "b", "a", "b", "a"], ["a", "zzz"]])
def test_compare_refuses(spark, names):
    from panelkit.operators.lookups import compare
    seg = spark.createDataFrame([("a", "r", "s", 1.0, 2.0, 3.0, 4.0, 5.0), ("b", "r", "s", 1.0, 2.0, 3.0, 4.0, 5.0)],
                                "entity string, region string, cluster_name string, share_global_pct double, "
                                "growth_forecast double, acceleration double, predictability double, ips double")
    with pytest.raises(ValueError):
        compare(seg, names)
