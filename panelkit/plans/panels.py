"""Panels derived from the driver tables.

A panel is a long table ``(entity, region, category, t, period_label, value)``
with one row per (series, period); a series is ``(entity, category)``.  The
panels are dense: every series has every period of the data span, absent
cells are 0 (the reference's table is a full grid).

Panel A: nation x market segment x quarter, sum of order totals.
Panel B: user x day, sum of event values.

Scale notes.  Raw rows are pre-aggregated map-side (partial HashAggregate)
before every shuffle, so a hot customer or user collapses to one row per
period per task before it moves.  The dimension tables nation/region have a
fixed size (the TPC-H schema) and are broadcast behind a row-count check.
The dense grid is produced per series from its ordered cells, each of which
fills the periods up to the next, so there is no cross join of series x periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import MONEY
from ..operators.joins import broadcast_if_small
from ..sources.tables import read_table

PANEL_COLUMNS = ["entity", "region", "category", "t", "period_label", "value"]


def _densify(cells: DataFrame, keys: list[str], label) -> DataFrame:
    """cells(keys..., q, v decimal) -> dense (keys..., q, t, value double).

    ``label`` maps the absolute period number q to its text label.
    """
    series = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "v"))).alias("cells"))
    # bounds come from the series' cells, so the fact table is scanned once
    # (both branches share the same exchange, which Spark reuses)
    bounds = series.select(F.col("cells")[0]["q"].alias("a"), F.element_at("cells", -1)["q"].alias("b")) \
        .agg(F.min("a").alias("q0"), F.max("b").alias("q1"))
    zero = F.lit(0).cast(MONEY)
    lead = F.when(F.col("cells")[0]["q"] > F.col("q0"), F.array(F.struct(F.col("q0").alias("q"), zero.alias("v"))))
    filled = (series.crossJoin(F.broadcast(bounds))          # one-row aggregate
              .select(*keys, "q0", "q1", F.concat(F.coalesce(lead, F.slice("cells", 1, 0)), "cells").alias("cells")))
    # a cell reaches up to the next one, so a series costs its periods once
    runs = F.transform("cells", lambda c, i: F.struct(
        c["q"].alias("q"), c["v"].alias("v"), F.coalesce(F.get("cells", i + 1)["q"] - 1, F.col("q1")).alias("upto")))
    grid = (filled.select(*keys, "q0", F.explode_outer(runs).alias("r"))
            .select(*keys, "q0", "r", F.explode(F.sequence("r.q", "r.upto")).alias("q")))
    return grid.select(
        *keys,
        (F.col("q") - F.col("q0")).cast("int").alias("t"),
        label(F.col("q")).alias("period_label"),
        F.when(F.col("q") == F.col("r.q"), F.col("r.v")).otherwise(zero).cast("double").alias("value"),
    )


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return n.join(broadcast_if_small(r), n.n_regionkey == r.r_regionkey) \
        .select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("region"))


def panel_a_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, region, category, q, v) for cells that have orders."""
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    q = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")
    # Pre-aggregate per (customer, quarter) before joining: a hot customer
    # becomes at most one row per quarter per map task.
    per_cust = o.groupBy("o_custkey", q).agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    per_seg = (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
               .groupBy("c_nationkey", F.col("c_mktsegment").alias("category"), "q")
               .agg(F.sum("v").cast(MONEY).alias("v")))
    nr = broadcast_if_small(nation_region(spark, sf_dir))
    return per_seg.join(nr, per_seg.c_nationkey == nr.n_nationkey) \
        .select("entity", "region", "category", "q", "v")


def quarter_label(q):
    return F.concat(F.floor(q / 4).cast("string"), F.lit("/Q"), (q % 4 + 1).cast("string"))


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense Panel A: nation x segment x quarter."""
    return _densify(panel_a_cells(spark, sf_dir), ["entity", "region", "category"], quarter_label) \
        .select(*PANEL_COLUMNS)


def day_label(q):
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), q.cast("int")), "yyyy/MM/dd")


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense Panel B: user x day, sum of event values (scale panel)."""
    e = read_table(spark, sf_dir, "events", "user_id", "ts", "value")
    q = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("q")
    cells = e.groupBy(F.col("user_id").alias("entity"), q) \
        .agg(F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("v")) \
        .withColumn("region", F.lit("ALL")).withColumn("category", F.lit("events"))
    return _densify(cells, ["entity", "region", "category"], day_label).select(*PANEL_COLUMNS)

