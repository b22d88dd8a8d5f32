"""Reshape and dimension enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MONEY


def period_columns(df: DataFrame) -> list[str]:
    """A period column is any column whose name contains '/'."""
    return [c for c in df.columns if "/" in c]


def period_labels(panel: DataFrame) -> list[str]:
    """Ordered period labels of a panel (bounded: one per period)."""
    rows = panel.select("t", "period_label").distinct().orderBy("t").collect()
    return [r["period_label"] for r in rows]


def to_wide(panel: DataFrame, labels: list[str] | None = None,
            ids=("entity", "category")) -> DataFrame:
    """Long -> wide: one column per period plus ``total`` (Panel A wide).

    The pivot values are given explicitly so Spark does not run a distinct
    job to discover them; the pivot is a single hash aggregate by ``ids``.
    """
    labels = labels or period_labels(panel)
    wide = (panel.groupBy(*ids).pivot("period_label", labels)
            .agg(F.sum(F.col("value").cast(MONEY)).cast("double")))
    total = sum((F.col(f"`{c}`").cast(MONEY) for c in labels[1:]), F.col(f"`{labels[0]}`").cast(MONEY))
    return wide.withColumn("total", total.cast("double"))


def to_long(wide: DataFrame, ids=("entity", "category")) -> DataFrame:
    """Wide -> long over the period columns; the label's first four
    characters are the year."""
    periods = period_columns(wide)
    long = wide.unpivot(list(ids), periods, "period_label", "value")
    return long.withColumn("year", F.substring("period_label", 1, 4).cast("int")) \
        .withColumn("value", F.col("value").cast("double"))


def pivot_sum_all(df: DataFrame, row: str, col: str, values: list, value: str = "value", other: str = "OTHER") -> DataFrame:
    """``row`` x ``col`` table of sums for the names in ``values``, and
    ``other``: the sum over all other names (null is one), NULL where none."""
    shown = [F.sum(F.when(F.col(col) == v, F.col(value))).alias(v) for v in values]
    rest = ~F.coalesce(F.col(col).isin(values), F.lit(False))
    return df.groupBy(row).agg(*shown, F.sum(F.when(rest, F.col(value))).alias(other))


def enrich(df: DataFrame, dim: DataFrame, key: str, attrs: list[str],
           default: str = "Unknown") -> DataFrame:
    """Left join a small dimension; missing keys get ``default``.

    ``dim`` must be a bounded dimension (the caller broadcasts it after a
    size check).
    """
    out = df.join(dim, on=key, how="left")
    for a in attrs:
        out = out.withColumn(a, F.coalesce(F.col(a), F.lit(default)))
    return out
