"""Segmented entities behind the card and look-up queries.

Two segmentations feed the same queries: the K-Means clusters, which SQL can't
repeat, and the regions of the entities, a fixed assignment from the tables
that DuckDB checks (queries ``*_by_region``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import rules as RU
from .catalog import register
from .stages import SegmentStages, stages_for


class Segments(NamedTuple):
    rows: DataFrame          # scored entities with cluster and cluster_name
    centroids: DataFrame     # cluster, cluster_name, n_entities and the mean features
    panel: DataFrame


def by_kmeans(st: SegmentStages) -> Segments:
    return Segments(st.segments, st.centroids, st.panel)


def by_region(st: SegmentStages) -> Segments:
    """Regions as segments: means of their entities, named by the same rules."""
    means = st.scored.groupBy("region").agg(F.count(F.lit(1)).cast("int").alias("n_entities"),
                                            *[F.avg(c).alias(c) for c in FT.CLUSTER_FEATURES])
    order = Window.orderBy("region")                                   # one row per region
    cent = RU.name_segments(means.withColumn("cluster", (F.row_number().over(order) - 1).cast("int")))
    rows = st.scored.join(cent.select("region", "cluster", "cluster_name"), "region")
    return Segments(rows, cent, st.panel)


REGION_SQL = """,
rmean AS (SELECT region, CAST(row_number() OVER (ORDER BY region) - 1 AS INTEGER) AS cluster, count(*) AS n_entities,
            avg(growth_forecast) AS growth_forecast, avg(acceleration) AS acceleration, avg(cv) AS cv,
            avg(predictability) AS predictability FROM strat GROUP BY region),
rbase AS (SELECT *, CASE WHEN growth_forecast < -8 THEN 'Crisis Económica' WHEN growth_forecast < 0 THEN 'Estancamiento'
            WHEN acceleration > 1.5 THEN 'Aceleración Sostenida' WHEN growth_forecast > 2 THEN 'Crecimiento Maduro'
            WHEN growth_forecast > 0.5 THEN 'Maduros Estables' ELSE 'Estables Predecibles' END AS base FROM rmean),
rdup AS (SELECT *, count(*) OVER (PARTITION BY base) AS dup,
           row_number() OVER (PARTITION BY base ORDER BY growth_forecast, cluster) AS rk FROM rbase),
rcent AS (SELECT *, CASE WHEN dup = 1 THEN base
            WHEN base = 'Estancamiento' THEN base || CASE WHEN rk = 1 THEN ' Severo' ELSE ' Leve' END
            WHEN base = 'Crecimiento Maduro' THEN base || CASE WHEN rk = 1 THEN ' Lento' ELSE ' Rápido' END
            ELSE base || ' (variante ' || CAST(rk AS VARCHAR) || ')' END AS cluster_name FROM rdup),
segs AS (SELECT s.*, c.cluster, c.cluster_name FROM strat s JOIN rcent c ON c.region = s.region)"""


def register_both(name: str, sql: str):
    """Register ``fn(segments)`` as ``name`` on the K-Means segments and, with
    its SQL, as ``<name>_by_region`` on the regions."""
    def deco(fn):
        register(name)(lambda spark, sf: fn(by_kmeans(stages_for(spark, sf))))
        register(f"{name}_by_region", sql)(lambda spark, sf: fn(by_region(stages_for(spark, sf))))
        return fn
    return deco
